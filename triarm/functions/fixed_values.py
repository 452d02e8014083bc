"""Fixed values.

These strings and numbers are part of the results (prompts, class lookups,
published labels), so they are stated as they are.
"""

# Texts longer than this are filtered out or cut in a prompt.
MAX_CHARACTERS = 1_000

# Prompt pieces.
QUERY_MARKER = "### Text:"
ANSWER_MARKER = " ### Answer:"
INSTRUCTION_OPENING = "Your task is to classify a given text as one of these categories:\n"

# Arms, effects as (treatment, control), display names.
ARMS = ("base", "extra", "test")
EFFECTS = {"boost": ("extra", "base"), "bias": ("test", "extra")}
EFFECT_NAMES = {"boost": "pretraining boost", "bias": "evaluation bias"}

# The columns of the accuracy table and its maximal replicate group.
ACCURACY_COLUMNS = ("base", "extra", "test", "majority", "majority_all")
REPLICATE_GROUP = ("num_train", "num_test", "lm_type", "dataset")

# The 25 classification tasks as (location, class names, task text).
TASKS = (
    ("ag_news", ("World", "Sports", "Business", "Sci/Tech"),
     "The text is a news article. Answer with its topic."),
    ("SetFit/amazon_counterfactual_en", ("not counterfactual", "counterfactual"),
     "The text is an Amazon product review. Answer with whether or not the text contains a counterfactual statement, which describes an event that did not or cannot take place."),
    ("app_reviews", ("1", "2", "3", "4", "5"),
     "The text is an app review. Answer with a rating from 1-5, where 1 indicates that the review says the app is bad, and 5 stars indicates that the review says the app is great."),
    ("blog_authorship_corpus", ("female", "male"),
     "The text is a blog post. Answer with your best guess for the gender of the post's author."),
    ("christinacdl/clickbait_notclickbait_dataset", ("not clickbait", "clickbait"),
     "The text is the headline of an article. Answer with whether or not the headline is clickbait."),
    ("climate_fever", ("supported", "refuted", "not enough info", "disputed"),
     "The text is a claim about climate change. Answer with how scientifically evidenced the claim is."),
    ("aladar/craigslist_bargains", ("bike", "car", "electronics", "furniture", "housing", "phone"),
     "The text is a dialogue between a buyer and seller on Craigslist. Answer with the category of the product they are discussing."),
    ("disaster_response_messages", ("direct message", "news story", "social media post"),
     "The text is a disaster response message. Answer with the most likely source of the message"),
    ("aladar/emo", ("others", "happy", "sad", "angry"),
     "The text is an utterance from a dialogue. Answer with the underlying emotion of the utterance."),
    ("dair-ai/emotion", ("sadness", "joy", "love", "anger", "fear", "surprise"),
     "The text is a Twitter message. Answer with its underlying emotion."),
    ("SetFit/enron_spam", ("ham", "spam"),
     "The text is the subject and message of an email. Answer with whether or not the email is spam or ham (i.e., not spam)."),
    ("financial_phrasebank", ("negative", "neutral", "positive"),
     "The text is a sentence from financial news. Answer with the sentiment of this sentence."),
    ("classla/FRENK-hate-en", ("LGBT", "migrants"),
     "The text is a Facebook comment on a news article. Answer with the topic of the news article."),
    ("hyperpartisan_news_detection", ("not hyperpartisan", "hyperpartisan"),
     "The text is the headline of a news article. Answer with whether or not it is hyperpartisan."),
    ("limit", ("no motion", "motion"),
     "Answer with whether the text describes the movement of a physical entity (motion) or not (no motion)."),
    ("AmazonScience/massive",
     ("social", "transport", "calendar", "play", "news", "datetime", "recommendation", "email", "iot",
      "general", "audio", "lists", "qa", "cooking", "takeaway", "music", "alarm", "weather"),
     "The text is an utterance from a person to a voice assistant. Answer with the domain of the utterance."),
    ("movie_rationales", ("negative", "positive"),
     "The text is a movie review. Answer with its sentiment."),
    ("mteb/mtop_domain",
     ("messaging", "calling", "event", "timer", "music", "weather", "alarm", "people", "reminder",
      "recipes", "news"),
     "The text is an utterance from a person to a voice assistant. Answer with the domain of the utterance."),
    ("ccdv/patent-classification",
     ("Human Necessities", "Performing Operations; Transporting", "Chemistry; Metallurgy",
      "Textiles; Paper", "Fixed Constructions",
      "Mechanical Engineering; Lightning; Heating; Weapons; Blasting", "Physics", "Electricity",
      "General tagging of new or cross-sectional technology"),
     "The text is the title of a patent and its abstract. Answer with its domain."),
    ("rotten_tomatoes", ("negative", "positive"),
     "The text is a movie review. Answer with its sentiment."),
    ("silicone", ("commissive", "directive", "inform", "question"),
     "The text is an utterance. Answer with its broader intention."),
    ("trec",
     ("Abbreviation", "Entity", "Description and abstract concept", "Human being", "Location",
      "Numeric value"),
     "The text is a question. Answer with the broader category it belongs to."),
    ("tweets_hate_speech_detection", ("not hate speech", "hate speech"),
     "The text is a tweet. Answer with whether or not it may be associated with hate speech, i.e., it has a racist or sexist sentiment associated with it."),
    ("yahoo_answers_topics",
     ("Society & Culture", "Science & Mathematics", "Health", "Education & Reference",
      "Computers & Internet", "Sports", "Business & Finance", "Entertainment & Music",
      "Family & Relationships", "Politics & Government"),
     "The text is a question title and body from Yahoo Answers. Answer with its topic."),
    ("yelp_review_full", ("1", "2", "3", "4", "5"),
     "The text is a Yelp review. Answer with a rating from 1-5, where 1 indicates that the review says the business is bad, and 5 stars indicates that the review says the business is great."),
)

# The one subset (configuration) that is read of some tasks.
SUBSETS = {
    "financial_phrasebank": "sentences_allagree",
    "hyperpartisan_news_detection": "bypublisher",
    "AmazonScience/massive": "en-US",
    "mteb/mtop_domain": "en",
    "ccdv/patent-classification": "abstract",
    "silicone": "dyda_da",
}

# The raw columns of each task as Spark SQL (text, label, rows kept).
RAW_COLUMNS = {
    "app_reviews": ("review", "star - 1", None),
    "blog_authorship_corpus": ("text", "map('female', 0, 'male', 1)[gender]", "length(text) < 1000"),
    "climate_fever": ("claim", "claim_label", None),
    "aladar/craigslist_bargains": ("text", "label", "text is not null"),
    "disaster_response_messages": (
        "message", "map('direct', 0, 'news', 1, 'social', 2)[genre]", "length(message) between 1 and 999"),
    "SetFit/enron_spam": ("text", "label", "length(text) > 0"),
    "financial_phrasebank": ("sentence", "label", None),
    "classla/FRENK-hate-en": ("text", "map('lgbt', 0, 'migrants', 1)[topic]", "length(text) < 1000"),
    "hyperpartisan_news_detection": ("title", "hyperpartisan", "length(title) > 0"),
    "limit": ("sentence", "map('no', 0, 'yes', 1)[motion]", None),
    "AmazonScience/massive": ("utt", "scenario", None),
    "movie_rationales": ("review", "label", None),
    "ccdv/patent-classification": ("text", "label", "length(text) < 1000"),
    "silicone": ("Utterance", "Label", None),
    "trec": ("text", "coarse_label", None),
    "tweets_hate_speech_detection": ("tweet", "label", None),
    "yahoo_answers_topics": ("concat(question_title, '\\n', question_content)", "topic", None),
}
