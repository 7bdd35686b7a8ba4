"""Fixed resource values.

Everything in this file is a FIXED VALUE list: results depend on these exact
entries, so they are written out plainly, in natural order, in one place.
Users may pass their own tables instead (every operator that uses one takes it
as a parameter).
"""

from __future__ import annotations


# --- FIXED VALUES: English stopwords -------------------------------------
# Spark MLlib's default English list, StopWordsRemover.loadDefaultStopWords
# ("english"), 181 words (a test checks the two stay equal).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing a an the and but "
    "if or because as until while of at by for with about against between into "
    "through during before after above below to from up down in out on off over "
    "under again further then once here there when where why how all any both "
    "each few more most other some such no nor not only own same so than too "
    "very s t can will just don should now i'll you'll he'll she'll we'll "
    "they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's we're "
    "they're i've we've you've they've isn't aren't wasn't weren't haven't "
    "hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't "
    "can't couldn't cannot could here's how's let's ought that's there's what's "
    "when's where's who's why's would"
).split()

# --- FIXED VALUES: vowels for the syllable counter -------------------------
VOWELS = "aeiouyàáâãäåæèéêëìíîïòóôõöøœùúûüýÿ"

# --- FIXED VALUES: lexicon sentiment constants (Hutto & Gilbert 2014) ------
SENTIMENT_ALPHA = 15.0       # compound = s / sqrt(s*s + alpha)
BOOSTER_INCREMENT = 0.293    # added (in the sign of the word) by a booster
NEGATION_SCALAR = -0.74      # multiplier when one of the 3 previous tokens negates
NEGATION_WINDOW = 3

# --- FIXED VALUES: seed sentiment lexicon (term, valence on -4..4) ---------
SEED_LEXICON = [
    ("good", 1.9), ("great", 3.1), ("excellent", 3.2), ("best", 3.2),
    ("better", 1.9), ("amazing", 2.8), ("awesome", 3.1), ("wonderful", 2.7),
    ("fantastic", 2.6), ("happy", 2.7), ("love", 3.2), ("like", 1.5),
    ("nice", 1.8), ("helpful", 1.7), ("useful", 1.6), ("easy", 1.9),
    ("clear", 1.6), ("free", 2.3), ("success", 2.7), ("successful", 2.8),
    ("win", 2.8), ("benefit", 2.0), ("improve", 1.9), ("improved", 2.1),
    ("safe", 1.9), ("secure", 1.4), ("strong", 2.3), ("recommend", 1.5),
    ("trust", 2.3), ("reliable", 1.9), ("fast", 1.3), ("quality", 1.7),
    ("positive", 2.6), ("perfect", 2.7), ("enjoy", 2.2), ("fun", 2.3),
    ("bad", -2.5), ("worse", -2.1), ("worst", -3.1), ("poor", -2.1),
    ("terrible", -2.1), ("awful", -2.0), ("horrible", -2.5), ("hate", -2.7),
    ("sad", -2.1), ("angry", -2.3), ("problem", -1.7), ("problems", -1.7),
    ("risk", -1.1), ("threat", -2.4), ("attack", -2.1), ("attacks", -2.1),
    ("fail", -2.5), ("failed", -2.3), ("failure", -2.3), ("error", -1.7),
    ("loss", -1.3), ("lost", -1.3), ("difficult", -1.5), ("hard", -0.4),
    ("slow", -0.7), ("broken", -2.3), ("dangerous", -2.1), ("scam", -2.8),
    ("spam", -1.5), ("fraud", -2.8), ("crime", -2.5), ("wrong", -2.1),
    ("negative", -2.7), ("weak", -1.9), ("pain", -2.3), ("damage", -2.2),
    ("vulnerable", -0.9), ("breach", -1.9), ("steal", -2.2), ("stolen", -2.2),
]

# --- FIXED VALUES: negation words ------------------------------------------
NEGATIONS = [
    "not", "no", "never", "none", "nobody", "nothing", "neither", "nor",
    "nowhere", "cannot", "without", "isn't", "aren't", "wasn't", "weren't",
    "don't", "doesn't", "didn't", "won't", "wouldn't", "can't", "couldn't",
    "shouldn't", "hasn't", "haven't", "hadn't",
]

# --- FIXED VALUES: boosters (+1 increases, -1 decreases intensity) --------
BOOSTERS = [
    ("very", 1), ("really", 1), ("extremely", 1), ("absolutely", 1),
    ("completely", 1), ("highly", 1), ("incredibly", 1), ("totally", 1),
    ("particularly", 1), ("especially", 1), ("so", 1), ("most", 1),
    ("slightly", -1), ("somewhat", -1), ("barely", -1), ("hardly", -1),
    ("marginally", -1), ("partly", -1), ("little", -1),
]

# --- FIXED VALUES: seed gazetteer (phrase, entity type) --------------------
SEED_GAZETTEER = [
    ("Google", "ORGANIZATION"), ("Microsoft", "ORGANIZATION"),
    ("Apple", "ORGANIZATION"), ("Amazon", "ORGANIZATION"),
    ("Cisco", "ORGANIZATION"), ("IBM", "ORGANIZATION"),
    ("United Nations", "ORGANIZATION"), ("European Union", "ORGANIZATION"),
    ("New York", "GPE"), ("London", "GPE"), ("Paris", "GPE"),
    ("Berlin", "GPE"), ("Madrid", "GPE"), ("Tokyo", "GPE"),
    ("United States", "GPE"), ("France", "GPE"), ("Germany", "GPE"),
    ("Spain", "GPE"), ("China", "GPE"), ("India", "GPE"),
    ("Europe", "LOCATION"), ("Africa", "LOCATION"), ("Asia", "LOCATION"),
    ("John Smith", "PERSON"), ("Jane Doe", "PERSON"),
]


def sql_string_list(values) -> str:
    """Render values as a SQL list literal body: 'a', 'b''s', ..."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)
