"""Fixed values that results depend on: keyword lists, markers, constants."""

# Exercise keywords by movement class.
UPPER_COMPOUND = ["bench", "press", "row", "pull up", "pull-up", "chin up", "chin-up",
                  "lat pulldown", "pulldown"]
LOWER_COMPOUND = ["squat", "deadlift", "rdl", "lunge", "leg press", "hip thrust"]
ISOLATION = ["curl", "extension", "raise", "fly", "pushdown", "pressdown", "shrug", "calf"]
BODYWEIGHT = ["plank", "crunch", "sit up", "sit-up", "push up", "push-up", "chin up", "chin-up",
              "pull up", "pull-up", "dip"]
MODEL_GROUPS = ["global", "upper_compound", "lower_compound", "isolation", "bodyweight"]

# Lifts in reporting order and the names they go by.
LIFT_ALIASES = {
    "bench": ["bench", "bench press", "paused bench press", "close grip bench press", "spoto press"],
    "squat": ["squat", "back squat", "front squat", "box squat", "pause squat", "hack squat"],
    "deadlift": ["deadlift", "romanian deadlift", "rdl", "sumo deadlift", "conventional deadlift",
                 "rack pull"],
    "press": ["overhead press", "strict press", "push press", "shoulder press"],
}

# Phrases that mark a question as asking for a next weight.
PREDICTION_MARKERS = ["what should i", "what weight should i", "next weight", "next session",
                      "next workout", "what should i bench", "what should i squat",
                      "what should i deadlift"]

# Phrases that mark a question as asking for an explanation.
EXPLANATORY_PHRASES = ["what is", "what are", "best", "worst", "how to", "why", "guide", "explain",
                       "difference"]

# Phrases of low-value text, trusted sites, rerank constants.
LOW_VALUE_MARKERS = ["in this video", "today we're", "today we are", "i'm going to", "i'll be",
                     "tier list", "top 10", "top five", "make sure", "thanks for watching",
                     "welcome back", "welcome to the video", "feature image", "shutterstock",
                     "link in the description"]
TRUSTED_SITES = ["barbellmedicine.com", "strongerbyscience.com", "powerliftingtechnique.com",
                 "pubmed.ncbi.nlm.nih.gov", "pmc.ncbi.nlm.nih.gov"]
LOW_VALUE_WINDOW = 300
TITLE_WEIGHT = 0.18
EXPLANATORY_BONUS = 0.05
TRUSTED_BONUS = 0.03
LOW_VALUE_PENALTY = 0.08

# Fetch errors that mean "blocked", for article and for transcript fetches.
BLOCK_TOKENS = ["403", "429", "forbidden", "too many requests", "access denied", "blocked", "captcha"]
TRANSCRIPT_BLOCK_PHRASES = ["youtube is blocking requests from your ip", "ip has been blocked",
                            "requestblocked", "ipblocked"]

# Assistant texts that report an internal error (case matters).
INTERNAL_ERROR_MARKERS = [
    "I reached the chat model, but it returned an empty response",
    "I could not get a non-empty chat response",
    "I could not reach the chat model",
    "I ran into an error while generating a reply",
]

# Sizes and limits.
CHUNK_WORDS = 180
CHUNK_OVERLAP = 40
TOP_K = 3
OVERFETCH = 5
MIN_CANDIDATES = 20
EXCERPT_CHARS = 350
CHAT_WINDOW = 8
DAILY_PROMPTS = 30
LEARNED_MODEL_MIN_ROWS = 500
TRAIN_RATIO = 0.8
MIN_GROUP_ROWS = 10
HISTORY_WINDOW = 3

# Headings and notes of a context text.
EXCERPTS_HEADING = "Relevant training context:"
HISTORY_HEADING = "User workout context:"
PROFILE_HEADING = "User profile context:"
PREDICTION_HEADING = "Prediction context:"
NO_EXCERPTS = "No relevant training context yet."
NO_HISTORY = "- No logged workout history found."
NO_PROFILE = "- No user profile found."
EMPTY_PROFILE = "- No usable user profile fields found."
NOT_ASKED = "- No next-weight prediction requested."
NO_TARGET = "- I could not find a matching logged exercise to estimate the next weight."
UNAVAILABLE = "- XGBoost prediction unavailable: "
INDEX_MISSING = "RAG index unavailable ({})."
LEARNED_NAME = "XGBoost"
RULE_NAME = "Baseline"
PROFILE_LABELS = {"goal": "Goal", "experience_level": "Experience level", "equipment_access": "Equipment access",
                  "training_frequency": "Training frequency"}
