"""Word lists and names the results depend on.

Everything in this module is a fixed value: changing one changes the features.
"""

# Phrases counted by ai_filler_count.
FILLER_PHRASES = (
    "it is important to note", "it is worth noting", "in conclusion",
    "in summary", "to summarize", "overall,", "furthermore,", "moreover,",
    "additionally,", "it is essential", "plays a crucial role",
    "it is crucial", "delve into", "dive into", "in today's world",
    "in the modern world", "as an ai", "as a language model", "i cannot",
    "i'm unable to", "certainly!", "absolutely!", "of course!",
    "great question", "that's a great",
)

# Hedge words, in published order.
HEDGE_WORDS = (
    "perhaps", "possibly", "probably", "generally", "typically",
    "usually", "often", "sometimes", "certain", "various",
    "numerous", "significant", "important", "key", "crucial",
    "essential", "effective", "efficient", "relevant", "appropriate",
)

# Function words, in published order.
FUNCTION_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been",
    "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "shall", "can", "need",
    "and", "or", "but", "if", "then", "because", "so", "yet",
    "for", "nor", "not", "in", "on", "at", "to", "of", "by",
    "with", "about", "against", "between", "through", "during",
    "this", "that", "these", "those", "it", "its",
)

# Personal pronouns, in published order.
PERSONAL_PRONOUNS = (
    "i", "me", "my", "mine", "myself",
    "we", "us", "our", "ours", "ourselves",
    "you", "your", "yours", "yourself", "yourselves",
)

# Transition words, in published order. The two entries with
# blanks never equal a token, so they count nothing.
TRANSITION_WORDS = (
    "first", "second", "third", "finally", "lastly",
    "additionally", "furthermore", "moreover", "however",
    "nevertheless", "in addition", "on the other hand",
    "therefore", "thus", "consequently", "hence",
    "meanwhile", "subsequently", "accordingly",
)

# Sentence openers, matched as prefixes.
LIST_STARTERS = (
    "first", "second", "third", "finally", "lastly", "additionally",
    "furthermore", "moreover", "however", "nevertheless", "in addition",
    "on the other hand",
)

# The [a-z]+ entries of Spark's English stop list (entries with
# an apostrophe can never equal a token). A test compares the two.
STOP_WORDS = (
    "i", "me", "my", "myself", "we", "our", "ours", "ourselves", "you",
    "your", "yours", "yourself", "yourselves", "he", "him", "his",
    "himself", "she", "her", "hers", "herself", "it", "its", "itself",
    "they", "them", "their", "theirs", "themselves", "what", "which", "who",
    "whom", "this", "that", "these", "those", "am", "is", "are", "was",
    "were", "be", "been", "being", "have", "has", "had", "having", "do",
    "does", "did", "doing", "a", "an", "the", "and", "but", "if", "or",
    "because", "as", "until", "while", "of", "at", "by", "for", "with",
    "about", "against", "between", "into", "through", "during", "before",
    "after", "above", "below", "to", "from", "up", "down", "in", "out",
    "on", "off", "over", "under", "again", "further", "then", "once",
    "here", "there", "when", "where", "why", "how", "all", "any", "both",
    "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "s", "t",
    "can", "will", "just", "don", "should", "now", "cannot", "could",
    "ought", "would",
)

# Genre classes in label order; the first two count as formal.
GENRES = ("encyclopedic", "academic", "informal", "general")
FORMAL_GENRES = ("encyclopedic", "academic")

# The feature vector, in order.
FEATURE_NAMES = (
    "sent_count", "avg_sent_len_words", "std_sent_len_words", "burstiness",
    "max_sent_len", "min_sent_len",
    "word_count", "avg_word_len_chars", "std_word_len_chars",
    "unique_word_ratio", "hapax_ratio", "long_word_ratio",
    "vocab_size", "function_word_ratio", "hedge_word_ratio",
    "comma_per_word", "period_per_word", "exclamation_per_word",
    "question_per_word", "semicolon_per_word", "colon_per_word",
    "flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog",
    "unigram_entropy", "bigram_entropy", "char_bigram_entropy",
    "ai_filler_count", "ai_filler_density", "list_starter_ratio",
    "uppercase_ratio", "digit_ratio",
    "avg_paragraph_len", "paragraph_count", "sent_len_entropy",
    "stopword_ratio",
    "personal_pronoun_ratio", "transition_word_density",
    "repeat_phrase_ratio",
)

# The features shown next to a verdict.
EXPLAINED_FEATURES = (
    "burstiness", "unique_word_ratio", "ai_filler_density",
    "hedge_word_ratio", "avg_sent_len_words", "unigram_entropy",
)
