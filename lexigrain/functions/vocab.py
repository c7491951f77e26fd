"""Small vocabularies of this library's own making."""

# Own lists, short on purpose; pass others where a list is a parameter.
HEDGES = ("perhaps", "maybe", "possibly", "probably", "seems", "appears", "somewhat", "likely", "in general", "it is possible", "as far as", "more or less")
WEASELS = ("various", "several", "many", "some people", "a number of", "quite", "very", "fairly", "extremely", "mostly")
WORDY = ("in order to", "due to the fact that", "at this point in time", "in the event that", "for the purpose of", "with regard to")
CLICHES = ("at the end of the day", "think outside the box", "low hanging fruit", "tip of the iceberg")
BE_FORMS = ("am", "is", "are", "was", "were", "be", "been", "being")
IRREGULAR = ("done", "made", "given", "taken", "known", "seen", "written", "shown", "built", "found", "held", "kept", "sent", "set", "read", "run", "chosen", "drawn", "driven", "begun")
STOPWORDS = ("the", "a", "an", "of", "to", "in", "and", "or", "is", "are", "was", "were", "be", "it", "that", "this", "for", "on", "with", "as", "at", "by", "from", "not", "but")
NONWORDS = ("irregardless", "alot", "supposably", "definately")
NOMINAL_ENDS = ("tion", "sion", "ment", "ness", "ance", "ence", "ity", "ism")
ADVERB_EXCEPTIONS = ("only", "family", "early", "daily", "reply", "apply", "supply", "july", "italy")
INCLUSIVE = (("whitelist", "allowlist"), ("blacklist", "denylist"), ("master", "main"), ("slave", "replica"), ("sanity check", "quick check"), ("manpower", "workforce"))
