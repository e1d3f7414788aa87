"""Label sets, question wording, prompts, rates and rule names.

They must equal the values results are compared against, so they are stated here as plain
text, together, and used nowhere else as literals.
"""

# --- questions -------------------------------------------------------------------------------

QUESTION_SET_VERSION = "2026-09-18.3"
YES_THRESHOLD = 0.5
FRUSTRATION_TOP = 4.0

FRUSTRATION_LEVELS = [
    "Not frustrated: positive, neutral or purely factual.",
    "Mild: a minor gripe or slight disappointment, said calmly.",
    "Clearly frustrated: annoyed or let down by a real problem.",
    "Very frustrated: angry, feels cheated, or the problem ruined the experience.",
    "Furious: hostile or emphatic language, demands a refund, or vows never to buy again.",
]

PROBLEM_CATEGORIES = {
    "none": "No problem is raised: praise, a neutral fact, or a recommendation.",
    "build_quality": "Durability or materials: breaks, bends, rusts, chips, feels cheap, wears out.",
    "performance": "Does not do its job well: heat, temperature control, accuracy, burn, flavour, results.",
    "ease_of_use": "Awkward, fiddly or confusing to use day to day.",
    "assembly": "Hard to assemble, poor instructions, missing or misfitting parts at setup.",
    "cleaning_maintenance": "Hard to clean, ash or grease handling, upkeep.",
    "size_capacity": "Too big, too small, too short, not enough capacity, does not fit.",
    "safety": "A risk of injury, burns, fire, gas leaks or unsafe food.",
    "shipping_delivery": "Late, lost or damaged in transit, wrong item delivered.",
    "customer_service": "Support, returns, warranty or refund handling.",
    "price_value": "Poor value for money, overpriced.",
    "general_dissatisfaction": "Overall disappointment with no specific cause named ('worst grill ever', 'a disaster').",
    "other": "A problem that fits none of the other categories.",
}

SENTIMENT_LABELS = {
    "positive": "Favourable about the product or experience.",
    "negative": "Unfavourable about the product or experience.",
    "mixed": "Both favourable and unfavourable in the same sentence.",
    "neutral": "Factual or descriptive with no clear opinion.",
}

RECOMMENDATION_LABELS = {
    "recommends": "Recommends the product to others or says it is worth buying.",
    "warns_against": "Tells others not to buy it or to look elsewhere.",
    "none": "Makes no recommendation either way.",
}

LANGUAGE_LABELS = [
    "english", "spanish", "portuguese", "french", "german", "italian", "dutch", "swahili",
    "afrikaans", "chinese", "japanese", "korean", "hindi", "arabic", "russian", "other",
]

INSTRUCTIONS = {
    "frustration": "How frustrated is the customer in this sentence? Judge the sentence, using the review only to resolve what it refers to.",
    "problem_category": "What kind of problem does this sentence raise? Choose 'none' if it raises no problem.",
    "language": "What language is the sentence written in?",
    "sentiment": "What is the sentiment of this sentence?",
    "recommendation": "Does this sentence itself tell others to buy the product, or tell them not to? A complaint on its own is not a warning.",
    "churn_risk": "Does this sentence itself say the customer is returning it, wants a refund, is switching to another brand or going back to their old one, or will not buy again? Answer from this sentence alone, not from the rest of the review.",
    "safety_concern": "Does this sentence describe a safety risk: injury, burns, fire, a gas leak, or food left unsafe to eat?",
    "suggestion": "Does this sentence explicitly suggest or wish for a specific change to the product (e.g. 'the cord could be longer', 'wish it came in more colours')? Describing a fault is not a suggestion.",
    "competitor_mention": "Does this sentence mention a product that is not in our range - a competitor, another brand, or a product the customer used before? Our range is: {range}.",
    "mentions": "Does this sentence mention or refer to the {product} ({category})? Yes if it is named, even in passing or by a short name, or if it is what the sentence is describing - including 'it' or 'these' when the review is about it.",
}

STATE_TASK = "Classify one sentence from a customer review of a barbecue product."
STATE_NOTE = "Judge what the sentence itself says. The full review is context for resolving what 'it' or 'this' refers to."

CHOICES = ["problem_category", "language", "sentiment", "recommendation"]
FLAGS = ["churn_risk", "safety_concern", "suggestion", "competitor_mention"]

# --- views -----------------------------------------------------------------------------------

NO_ISSUE = "no_issue"
NO_ISSUE_LABEL = "No issue raised"
SENTIMENTS = ["negative", "mixed", "positive"]
RISK_TIERS = ["At risk", "Frustrated", "Satisfied"]
AT_RISK_FRUSTRATION = 3.0
FRUSTRATED_FRUSTRATION = 2.0
FLOW_LEVELS = ["sentiment", "category", "product", "issue"]
EXPECTED_LANGUAGE = {"zulu": "other"}
EXCERPT_LENGTH = 110
CARRIED = [
    "customer_id", "product_id", "product_name", "product_category", "rating", "reviewed_at", "review_text",
    "text_language", "text_model", "tenure_days", "lifetime_revenue", "order_count", "days_since_last_order",
    "previous_reviews", "age", "gender", "country",
]

# --- texts -----------------------------------------------------------------------------------

WRITER_SYSTEM = (
    "You write realistic, varied customer reviews for products sold by a fictional barbecue retailer. "
    "Write only the review text as the customer would type it: no title, no star rating, no quotation "
    "marks, no preamble or explanation. Invent concrete, plausible details. Never mention that the "
    "review is generated or fictional."
)

WRITER_PROMPT = (
    "Product: {product_name} ({product_category}). {product_description}\n"
    "Stars the customer gave: {rating} of 5.\n"
    "How the customer feels: {feeling}.\n"
    "Focus mainly on: {aspect}.\n"
    "Write it in {language}.\n"
    "Length: about {sentences} sentences."
)

WRITER_LANGUAGE_NAMES = {
    "english": "English", "german": "German", "portuguese": "Brazilian Portuguese", "spanish": "Spanish",
    "japanese": "Japanese", "chinese": "Simplified Chinese", "swahili": "Swahili", "zulu": "Zulu",
}

# (upper bound of satisfaction, wording); the last wording has no bound
FEELINGS = [
    (0.15, "furious - the purchase was a real letdown and they feel cheated"),
    (0.35, "clearly disappointed and frustrated"),
    (0.5, "a bit let down; it has real flaws"),
    (0.65, "mostly satisfied, with reservations"),
    (0.85, "pleased; it does the job well"),
    (None, "delighted - they love it and would recommend it"),
]

CLASSIFIER_TOKENS_PER_SENTENCE = 2_750
CLASSIFIER_SECONDS_PER_SENTENCE = 0.30
CLASSIFIER_USD_PER_MILLION_INPUT = 0.042
CLASSIFIER_CONCURRENCY = 8
WRITER_PROMPT_TOKENS = 260
WRITER_TOKENS_PER_SENTENCE = 28
WRITER_CONCURRENCY = 8
WRITER_SECONDS_PER_REVIEW = 2.5

# --- profile ---------------------------------------------------------------------------------

SEASONAL_AMPLITUDE = 0.6
NORTHERN_PEAK_DAY = 196
DAYS_PER_YEAR = 365.25
# (month, day, boost, width in days)
HOLIDAYS = [(6, 16, 0.5, 7.0), (11, 28, 0.7, 7.0), (12, 12, 0.4, 7.0)]

REVIEW_BASE_RATE = 0.03
REVIEW_EXTREMITY_RATE = 0.45
REVIEW_SHARPNESS = 2.5
REVIEW_RATING_NOISE = 0.35

# --- data model ------------------------------------------------------------------------------

COUNTRIES = [
    "Australia", "Brazil", "Canada", "China", "Costa Rica", "Germany", "Japan",
    "New Zealand", "South Africa", "Tanzania", "United Kingdom", "United States",
]
CATEGORIES = ["grills", "accessories", "consumables"]
FUEL_TYPES = ["gas", "pellet", "charcoal", "electric", "any"]
GENDERS = ["female", "male"]
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+$"

INTEGRITY_RULES = {
    "order_customer": "order.customer_id exists",
    "line_order": "order_line.order_id exists",
    "line_product": "order_line.product_id exists",
    "order_has_line": "every order has a line",
    "order_after_signup": "order placed on or after signup",
    "order_total": "order_total equals the sum of its lines",
    "review_customer": "review.customer_id exists",
    "review_product": "review.product_id exists",
    "review_line": "review.order_line_id exists",
    "review_buyer": "review is by the customer who bought the line, for the product on it",
    "review_after_order": "review written after the order it reviews",
    "text_review": "review_text.review_id exists",
    "truth_review": "review_truth.review_id exists",
}
