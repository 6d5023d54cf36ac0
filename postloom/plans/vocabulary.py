"""Word lists passed to the registered queries.

Fixed values: category names are those the composites add up; the words are
common English function and everyday words.
"""

LEXICON = {
    "affect": ["happy", "sad", "good", "bad", "love", "hate", "fear", "rest", "hein"],
    "cogmech": ["think", "know", "because", "that", "or", "if", "but", "only"],
    "percept": ["see", "hear", "feel", "look", "hand", "ear", "sh"],
    "bio": ["eat", "sleep", "blood", "pain", "heart", "ha", "ea"],
    "social": ["friend", "family", "talk", "they", "he", "she", "other", "ther"],
    "work": ["work", "job", "office", "token", "license", "user"],
    "achiev": ["win", "lose", "success", "try", "best", "est"],
    "home": ["home", "house", "kitchen", "in"],
    "leisure": ["game", "music", "movie", "play", "song"],
    "money": ["money", "price", "pay", "cash", "bank", "card"],
    "relig": ["god", "church", "pray", "soul", "hell"],
    "death": ["dead", "die", "grave", "kill", "the"],
    "article": ["a", "an", "the"],
    "prep": ["of", "to", "in", "for", "on", "with", "by", "as", "at", "from", "an"],
    "conj": ["and", "or", "but", "as", "that"],
    "adverbs": ["very", "really", "only", "then", "than"],
    "negate": ["no", "not", "never", "none"],
    "auxvb": ["is", "was", "be", "are", "has", "had", "am"],
    "verbs": ["is", "was", "be", "are", "go", "went", "say", "said"],
    "quant": ["all", "few", "many", "more", "some", "on"],
    "relativ": ["in", "on", "at", "then", "ten", "over", "under"],
    "i": ["i", "me", "my", "mine"],
    "we": ["we", "us", "our", "ours"],
    "you": ["you", "your", "yours"],
    "ipron": ["it", "its", "this", "that", "those"],
    "future": ["will", "shall", "soon"],
    "past": ["was", "were", "had", "ago"],
    "present": ["is", "are", "now", "today"],
}

STEM_LEXICON = {
    "determiner": ["the*", "thi*", "that"],
    "ending": ["er*", "ing*", "tion*", "thing", "ers"],
    "accented": ["é*", "ä*", "ó*", "über*", "de"],
    "mixed": ["on*", "one", "only", "or", "a"],
    "rare": ["zukunft*", "xyl*"],
}

#: Entries of two words, as they may stand in any language's texts.
PHRASES = ["of the", "to the", "in a", "de la", "que el", "in the"]

#: Words of a lexicon category that no expression could hold.
LONG_LEXICON = 300_000

#: Weights per word or word pair of each label.
LABEL_WEIGHTS = {
    "anxiety": {"the": 2.0, "of": -3.0, "de": 1.0},
    "stress": {"a": 1.0, "is": 2.0, "der": 3.0, "la": -2.0},
    "depression": {"that": 5.0, "and": -1.0, "of the": 4.0},
    "suicide": {"en": 1.0, "le": 1.0, "die": -1.0, "on": -2.0},
    "psychosis": {"worthless": 1.0, "trash": 1.0, "stupid": 1.0},
    "loneliness": {"it": 2.0, "in": -1.0, "und": 2.0, "que": 1.0},
}
