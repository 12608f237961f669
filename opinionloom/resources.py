"""Built-in dictionaries. Every operator takes its dictionary as a parameter;
these are only the defaults."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

# --- Fixed values: the default aspect dictionary -------------------------------------------
ASPECTS = [
    "food", "meal", "dish", "dishes", "cuisine", "cooking", "recipe",
    "appetizer", "appetizers", "starter", "starters", "entree", "entrees",
    "main", "mains", "dessert", "desserts", "soup", "salad", "bread",
    "burger", "burgers", "steak", "steaks", "fish", "seafood", "chicken",
    "beef", "pork", "lamb", "pasta", "pizza", "sandwich", "sandwiches",
    "fries", "vegetables", "veggies", "rice", "noodles", "sauce", "sauces",
    "cheese", "meat", "protein", "side", "sides", "plate", "plates",
    "service", "staff", "server", "servers", "waiter", "waiters",
    "waitress", "waitresses", "bartender", "chef", "chefs", "manager",
    "host", "hostess", "team", "crew", "employee", "employees",
    "atmosphere", "ambiance", "ambience", "environment", "vibe", "mood",
    "decor", "decoration", "interior", "exterior", "design", "lighting",
    "music", "noise", "seating", "seats", "table", "tables", "chair", "chairs",
    "patio", "terrace", "dining", "room", "space", "place", "restaurant",
    "establishment", "venue", "location", "spot",
    "wait", "waiting", "timing", "time", "speed", "pace", "reservation",
    "reservations", "booking", "order", "orders", "delivery", "takeout",
    "portion", "portions", "size", "sizes", "presentation", "plating",
    "price", "prices", "pricing", "cost", "costs", "value", "money",
    "bill", "check", "charge", "charges", "expensive", "cheap", "affordable",
    "budget", "deal", "deals", "special", "specials",
    "quality", "freshness", "fresh", "flavor", "flavors", "taste", "tastes",
    "texture", "temperature", "hot", "cold", "warm", "cool", "seasoning",
    "salt", "spice", "spices", "preparation", "cooked",
    "drink", "drinks", "beverage", "beverages", "wine", "wines", "beer",
    "beers", "cocktail", "cocktails", "coffee", "tea", "water", "soda",
    "juice", "alcohol", "bar",
    "experience", "visit", "dinner", "lunch", "breakfast", "brunch",
    "overall", "general", "everything", "nothing",
]

# --- Fixed values: cue phrases, matched as literal substrings of the lower-cased text -------
HIDDEN_NEGATIVE = [
    "you get what you pay for",
    "matches the low prices",
    "reminds me of.*if.*lost",
    "would be.*if they fixed",
    "tries really hard",
    "certainly present",
    "adequate",
]

SARCASM_CUES = [
    "oh great", "just perfect", "wonderful", "brilliant", "amazing how", "fantastic", "super",
    "exactly what i needed", "so glad", "how exciting", "love it when", "my favorite",
    "couldn't be happier", "as if", "yeah right", "sure", "whatever", "obviously",
    "said no one ever", "i'm sure", "clearly", "of course", "big surprise", "oh joy",
    "can't wait", "thrilled",
]
QUESTIONED_POSITIVES = ["great", "perfect", "wonderful", "fantastic"]
CONTRADICTION_POSITIVES = ["amazing", "wonderful", "great", "excellent", "fantastic"]
CONTRADICTION_CONTRASTS = ["but", "however", "unfortunately", "disappointed"]

# Cues for the aspect flip: our own choice, consistent with the published test contract.
FLIP_SARCASTIC = ["oh wonderful", "oh great", "just perfect", "yeah right", "of course"]
FLIP_NEGATIVE = ["only bad", "bad", "terrible", "awful", "worst", "slow", "cold", "rude"]

# --- Fixed values: default emotion labels, in tie-break order --------------------------------
EMOTIONS = ["sadness", "joy", "love", "anger", "fear", "surprise"]

# --- Fixed values: calibration probes (text, expected class) ---------------------------------
PROBES = [
    ("I love this amazing restaurant!", "positive"),
    ("I hate this terrible place!", "negative"),
    ("This is okay", "neutral"),
]

# --- Fixed values: class index -> label of each catalogued sentiment model -------------------
_TWO = ("negative", "positive")
_TWO_REVERSED = ("positive", "negative")
_THREE = ("negative", "neutral", "positive")
_FIVE = ("very_negative", "negative", "neutral", "positive", "very_positive")

# model -> (labels by class index, writes LABEL_n, note)
MODELS: dict[str, tuple[tuple[str, ...], bool, str]] = {
    "siebert/sentiment-roberta-large-english": (_TWO, False, "two classes, English"),
    "RashidNLP/Amazon-Deberta-Base-Sentiment": (_THREE, True, "three classes, product reviews"),
    "dnzblgn/Sentiment-Analysis-Customer-Reviews": (_TWO_REVERSED, False, "two classes, index 0 is positive"),
    "Elron/deberta-v3-large-sentiment": (_THREE, True, "three classes, short posts"),
    "Kaludi/Reviews-Sentiment-Analysis": (_TWO, False, "two classes, reviews"),
    "tabularisai/robust-sentiment-analysis": (_FIVE, True, "five classes, English"),
    "tabularisai/multilingual-sentiment-analysis": (_FIVE, True, "five classes, many languages"),
    "VictorSanh/roberta-base-finetuned-yelp-polarity": (_TWO, False, "two classes, local-business reviews"),
    "textattack/bert-base-uncased-yelp-polarity": (_TWO, True, "two classes, local-business reviews"),
    "AirrStorm/DistilBERT-SST2-Yelp": (_TWO, False, "two classes, small model"),
    "karimbkh/BERT_fineTuned_Sentiment_Classification_Yelp": (_TWO, True, "two classes, restaurant reviews"),
    "pig4431/YELP_roBERTa_5E": (_FIVE, False, "five star classes"),
}

# --- Fixed values: base rows of the sample training set (features in FEATURES order) ---------
SAMPLE_ROWS = [
    ("Amazing food and excellent service! Highly recommend.",
     (1.0, 0.8, 0.9, 0.95, 2, 0, 0.85, 0.90, 2.5, 0.41, 0.3, 0.0, 0.1), "positive"),
    ("Terrible experience, cold food and rude staff.",
     (-1.0, -0.7, -0.8, 0.92, 0, 2, -0.75, 0.88, 1.8, 0.3, 0.5, 0.0, 0.2), "negative"),
    ("Food was okay, nothing special but not bad either.",
     (0.0, 0.1, 0.0, 0.6, 1, 1, 0.0, 0.7, 0.9, 0.15, 0.1, 0.0, 0.15), "neutral"),
    ("Great atmosphere but the wait time was too long.",
     (0.0, 0.3, 0.2, 0.75, 1, 1, 0.1, 0.8, 1.2, 0.2, 0.6, 0.0, 0.1), "neutral"),
    ("Outstanding! Best restaurant in town.",
     (1.0, 0.9, 0.95, 0.98, 1, 0, 0.9, 0.92, 3.0, 0.5, 0.2, 0.0, 0.05), "positive"),
]
# Features that receive noise, with the range they are clipped to.
SAMPLE_NOISE_RANGE = {
    "rule_polarity": (-1, 1),
    "sentiment_score": (-1, 1),
    "sentiment_confidence": (0, 1),
    "avg_aspect_score": (-1, 1),
    "avg_aspect_confidence": (0, 1),
    "emotion_score": (0, 6),
    "emotion_confidence": (0, 1),
    "emotion_distribution": (0, 1),
    "sarcasm_confidence": (0, 1),
}

# --- Fixed values: thresholds ------------------------------------------------------------------
RULE_CUTOFF = 0.05
LOW_CONFIDENCE = 0.6
FLAG_HIGH_CONFIDENCE = 0.9
REPORT_HIGH_CONFIDENCE = 0.8
SIGNIFICANT_EMOTION = 0.1
CONTEXT_WINDOW = 10
MIN_FEEDBACK_RECORDS = 10


@dataclass(frozen=True)
class Lexicon:
    """Word scores in thousandths, so that sums stay exact integers.

    `valence` drives the compound score, `polarity` the mean word polarity.
    `boosters` strengthen (or, when negative, weaken) the word that follows.
    The rest concerns the compound score only and is off unless given: `capitals` weighs words in capitals where a unit mixes
    cases, `contrast` lists the words (such as but) after which a unit counts more and before which less, and `idioms`
    gives word sequences a valence in the place of that of their words.
    """

    valence: Mapping[str, int]
    polarity: Mapping[str, int]
    boosters: Mapping[str, int] = field(default_factory=dict)
    negators: tuple[str, ...] = ()
    capitals: bool = False
    contrast: tuple[str, ...] = ()
    idioms: Mapping[str, int] = field(default_factory=dict)


_STRONG_GOOD = ("amazing awesome brilliant excellent exceptional fantastic flawless incredible love loved "
                "magnificent outstanding perfect stunning superb terrific thrilled wonderful").split()
_GOOD = ("attentive beautiful best better charming clean comfortable cozy crisp delicious delightful efficient "
         "enjoy enjoyed fair fast fresh friendly fun generous glad good great happy helpful impressed impressive "
         "juicy kind lovely nice pleasant polite prompt recommend refined relaxing satisfying smooth special "
         "tasty tender warm welcoming").split()
_BAD = ("bland boring burnt cold cramped crowded dirty disappointed disappointing dry dull expensive forgotten "
        "greasy ignored lacking late loud mediocre mess noisy overcooked overpriced poor problem salty slow soggy "
        "stale tough unfortunately unfriendly unhappy waste weak worse").split()
_STRONG_BAD = "abysmal appalling atrocious awful disgusting dreadful hate hated horrible rude terrible worst".split()

DEFAULT_LEXICON = Lexicon(
    valence={
        **dict.fromkeys(_STRONG_GOOD, 3000),
        **dict.fromkeys(_GOOD, 1900),
        **dict.fromkeys(_BAD, -1700),
        **dict.fromkeys(_STRONG_BAD, -2900),
    },
    polarity={
        **dict.fromkeys(_STRONG_GOOD, 900),
        **dict.fromkeys(_GOOD, 500),
        **dict.fromkeys(_BAD, -400),
        **dict.fromkeys(_STRONG_BAD, -900),
    },
    boosters={
        **dict.fromkeys("absolutely completely extremely incredibly really so totally truly very".split(), 293),
        **dict.fromkeys("almost barely hardly slightly somewhat".split(), -293),
    },
    negators=("not", "no", "never", "neither", "nor", "without", "cannot"),
)

STOP_WORDS = (
    "a about after all also an and any are as at be because been before but by can could did do does for from "
    "had has have he her here him his how i if in into is it its just me more most my no nor not of off on once "
    "only or other our out over own same she so some such than that the their them then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with "
    "you your"
).split()
