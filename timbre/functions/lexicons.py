"""Word lists and patterns that features and rules are defined by.

Results depend on them as they are; lists are in their conventional order.
"""

# Function words, the stop list of situation keywords.
FUNCTION_WORDS = """
a about above after again against all am an and any are as at be because been before being below between both but by
can could did do does doing down during each few for from further had has have having he her here hers herself him
himself his how i if in into is it its itself just me more most my myself no nor not now of off on once only or other
our ours ourselves out over own same she should so some such than that the their theirs them themselves then there
these they this those through to too under until up very was we were what when where which while who whom why will
with would you your yours yourself yourselves also although however therefore though thus yet whether upon within
without across among along around behind beside beyond toward towards via
""".split()
EXTRA_STOP_WORDS = "name url im dont thats its ive ill hi hey thanks ok okay yes no".split()

# Hedges, boosters, intensifiers, discourse markers.
HEDGES = [
    "maybe", "perhaps", "possibly", "probably", "might", "may", "could", "seems", "seem", "appears", "apparently",
    "i think", "i guess", "i suppose", "i believe", "i feel", "sort of", "kind of", "a bit", "a little", "somewhat",
    "fairly", "rather", "quite", "likely", "unlikely", "roughly", "about", "around", "tend to", "in general",
    "not sure", "if possible", "hopefully", "presumably", "arguably",
]
BOOSTERS = [
    "definitely", "certainly", "clearly", "obviously", "absolutely", "of course", "surely", "undoubtedly", "always",
    "never", "really", "truly", "totally", "completely", "exactly", "for sure", "no doubt", "indeed", "in fact",
    "actually", "literally", "honestly",
]
INTENSIFIERS = ["so", "very", "really", "super", "extremely", "incredibly", "totally", "absolutely", "hugely", "massively", "such", "too", "ever so", "properly"]
DISCOURSE_MARKERS = [
    "so", "well", "anyway", "anyways", "oh", "ah", "okay", "ok", "right", "now", "then", "also", "plus", "but",
    "and", "because", "actually", "basically", "honestly", "by the way", "in fact", "you know", "i mean", "like",
    "just so you know", "fyi", "to be honest", "tbh", "that said", "having said that",
]

# British and American spellings, counted independently of each other.
UK_US = [
    ("colour", "color"), ("favourite", "favorite"), ("organise", "organize"), ("organised", "organized"), ("realise", "realize"),
    ("apologise", "apologize"), ("recognise", "recognize"), ("centre", "center"), ("theatre", "theater"), ("travelling", "traveling"),
    ("travelled", "traveled"), ("cancelled", "canceled"), ("cancelling", "canceling"), ("behaviour", "behavior"), ("honour", "honor"),
    ("neighbour", "neighbor"), ("programme", "program"), ("cheque", "check"), ("licence", "license"), ("defence", "defense"),
    ("jewellery", "jewelry"), ("grey", "gray"), ("mum", "mom"), ("flat", "apartment"), ("holiday", "vacation"),
    ("whilst", "while"), ("amongst", "among"), ("learnt", "learned"), ("fulfil", "fulfill"), ("enrol", "enroll"),
]
UK, US = [a for a, _ in UK_US], [b for _, b in UK_US]

# Full forms that could be contracted, casual forms, profanity.
EXPANDABLE = [
    "do not", "does not", "did not", "is not", "are not", "was not", "were not", "have not", "has not", "cannot", "can not", "will not", "would not", "should not", "could not",
    "i am", "you are", "we are", "they are", "it is", "that is", "i will", "we will", "you will", "i have", "we have", "i would", "we would",
]
TEXTESE = [
    "lol", "haha", "hahaha", "omg", "tbh", "imo", "imho", "btw", "idk", "ikr", "ngl", "fyi", "pls", "plz", "thx", "ty", "u", "ur", "r", "gonna", "wanna", "gotta", "kinda", "sorta",
    "yeah", "yep", "yup", "nope", "nah", "ok", "okay", "cool", "awesome", "amazing", "lovely", "cheers", "mate", "x", "xx", "xxx",
]
PROFANITY = ["damn", "hell", "shit", "fuck", "fucking", "bloody", "crap", "bastard", "arse", "ass", "piss"]

# Pronouns by person.
PRONOUNS = {
    "first_singular": ["i", "me", "my", "mine", "myself", "i'm", "i've", "i'll", "i'd"],
    "first_plural": ["we", "us", "our", "ours", "ourselves", "we're", "we've", "we'll", "we'd"],
    "second": ["you", "your", "yours", "yourself", "yourselves", "you're", "you've", "you'll", "you'd", "u", "ur"],
    "third": ["he", "she", "they", "him", "her", "them", "his", "hers", "their", "theirs"],
}

# Function-word categories of style matching.
STYLE_CATEGORIES = {
    "personal_pronouns": "i me my mine we us our you your he she him her they them their".split(),
    "impersonal_pronouns": "it its this that these those anything something everything nothing".split(),
    "articles": "a an the".split(),
    "prepositions": "to of in for on with at by from about into over after under".split(),
    "auxiliary_verbs": "am is are was were be been being have has had do does did will would shall should can could may might must".split(),
    "high_frequency_adverbs": "very really so just then now also too quite still even".split(),
    "conjunctions": "and but or because so if while although though yet".split(),
    "negations": "no not never none nothing don't can't won't isn't didn't doesn't".split(),
    "quantifiers": "all some any many much few more most lots every each".split(),
}

# Cue patterns of social acts (lower case; matched without regard to case).
SOCIAL_CUES = {
    "greet": [r"^(hi|hey|hello|hiya|good (morning|afternoon|evening)|morning|evening)\b", r"^dear\b"],
    "thank": [r"\bthank(s| you)\b", r"\bcheers\b", r"\bappreciate(d)?\b", r"\bta\b"],
    "apologise": [r"\b(sorry|apologi[sz]e|apologies|my bad|excuse me)\b"],
    "offer": [r"\b(happy to|glad to|we can|i can|let me|would you like|shall i|we could|i could|feel free)\b"],
    "request": [r"\b(could you|can you|would you|please|pls|plz|do you mind|let us know|let me know|send us|dm us)\b"],
    "reassure": [r"\b(don'?t worry|no worries|no problem|not a problem|you'?re (all )?set|we'?ve got (you|this)|it'?s (all )?fine|rest assured|all good)\b"],
    "refuse": [r"\b(unfortunately|i'?m afraid|we can'?t|we cannot|not able to|unable to|won'?t be able|isn'?t possible|no longer)\b"],
    "close": [r"\b(have a (great|good|lovely|nice) (day|one|weekend|evening)|take care|speak soon|talk soon|best wishes|kind regards|best,|thanks again)\b"],
    "empathise": [r"\b(i understand|we understand|that sounds|i can imagine|must be (frustrating|annoying|hard)|totally get|completely understand|i hear you)\b"],
    "praise": [r"\b(great|amazing|awesome|love|lovely|brilliant|fantastic|wonderful) (question|idea|choice|news|to hear)\b"],
}
#: Acts for which a cue is enough without a model.
CUE_IS_ENOUGH = ("greet", "thank", "apologise", "refuse")

# Common English words that mark a turn as English.
ENGLISH_MARKERS = (
    "the you your we our is are was were be been have has had do does did not this that with for to of and it it's i'm we're you're can could would will please thanks thank "
    "sorry help hi hey what how when where why there here just get know let ok okay great yes no sure glad happy good my me from on at by an in a"
).split()

# Closed word classes of English, for shares that need no parser.
CLOSED_CLASSES = {
    "det": "a an the this that these those each every some any no another".split(),
    "pron": "i me my mine myself you your yours yourself he him his himself she her hers herself it its itself we us our ours they them their theirs who whom whose which what".split(),
    "adp": "about above across after against along among around at before behind below beneath beside between beyond by down during for from in inside into near of off on onto out over past since through to toward towards under until up upon with within without".split(),
    "cconj": "and but or nor yet so".split(),
    "sconj": "although because if since that though unless until when whenever where whereas whether while".split(),
    "aux": "am is are was were be been being have has had do does did will would shall should can could may might must".split(),
    "part": "not n't to".split(),
    "intj": "oh ah hi hey hello wow yes no yeah okay ok please thanks".split(),
}
MODALS = "can could may might must shall should will would".split()
NEGATIONS = "no not never none nothing nobody neither nor cannot can't won't don't isn't aren't wasn't weren't haven't hasn't hadn't doesn't didn't couldn't shouldn't wouldn't mustn't".split()
QUESTION_STARTS = "who what when where why how which whose is are do does did can could will would should have has".split()
# A small polarity list.
POSITIVE = "good great happy glad love lovely excellent wonderful perfect thanks thank enjoy enjoyed nice best pleased welcome amazing awesome brilliant fantastic".split()
NEGATIVE = "bad sad sorry terrible awful hate worst poor wrong problem problems annoyed angry disappointed unfortunately broken late delay delayed fail failed".split()

# Patterns. Digits are [0-9] so that all engines agree.
WORD = r"[A-Za-z][A-Za-z'’-]*|[0-9]+(?:[.,][0-9]+)?"
URLISH = r"https?://\S+|www\.\S+"
PLACEHOLDER = r"<[A-Z_]+(?:_[0-9]+)?>"
SENTENCE_BREAK = r"(?<=[.!?…])\s+(?=[A-Z0-9\"“'(<])|\n+"
CONTRACTION = r"\b\w+(?:'|’)(?:s|re|ve|ll|d|m|t)\b|\b(?:can't|won't|don't|isn't|aren't|wasn't|weren't|haven't|hasn't|hadn't|doesn't|didn't|couldn't|shouldn't|wouldn't|mustn't)\b"
EMOTICON = r"(?:[:;=8xX][-o^']?[)(\]\[dDpP/\\|*@3]|<3|\^_\^|:'\(|¯\\_\(ツ\)_/¯)"
OPENING_TOKEN = r"<[A-Z_]+(?:_[0-9]+)?>|[A-Za-z']+"
SIGNATURE = r"\s*[\^*/~\-–—]\s?[A-Z][A-Za-z]{0,14}\.?(?:\s+[0-9]/[0-9])?(?:\s*<URL>)?\s*$"
NAMED_FIRST = r"^\W*(hi|hey|hello|dear|thanks|thank you)?\W*<PERSON_[0-9]+>"
PRIVACY_TOKEN = r"[a-z0-9']+|<[a-z_0-9]+>"
# The emoji grammar: flags, key caps, pictographs with modifiers and joiners.
_PICTURE = r"[\x{1F000}-\x{1F0FF}\x{1F170}-\x{1F1E5}\x{1F200}-\x{1F2FF}\x{1F300}-\x{1F3FA}\x{1F400}-\x{1FAFF}\x{2600}-\x{27BF}\x{2B05}-\x{2B07}\x{2B1B}\x{2B1C}\x{2B50}\x{2B55}\x{231A}\x{231B}\x{23E9}-\x{23F3}\x{23F8}-\x{23FA}\x{25AA}\x{25AB}\x{25B6}\x{25C0}\x{25FB}-\x{25FE}\x{3030}\x{303D}\x{3297}\x{3299}]"
EMOJI = rf"(?:[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}|[0-9#*]\x{{FE0F}}?\x{{20E3}}|{_PICTURE}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*(?:\x{{200D}}{_PICTURE}[\x{{FE0F}}\x{{1F3FB}}-\x{{1F3FF}}]*)*)"

# What a feature says in a rule: category, wording for more of it, wording for less.
FEATURE_TEXT = {
    "words": ("structure", "Write longer messages than typical", "Keep messages short"),
    "words_per_sentence": ("syntax", "Use longer sentences", "Use short sentences"),
    "sentences": ("structure", "Write several sentences per message", "Say it in one or two sentences"),
    "exclamations_per_sentence": ("punctuation", "Use exclamation marks freely", "Avoid exclamation marks"),
    "questions_per_sentence": ("pragmatics", "Ask questions", "Rarely ask questions"),
    "ends_with_question": ("pragmatics", "End messages with a question", "Do not end on a question"),
    "ellipses_per_sentence": ("punctuation", "Trail off with ellipses", "Avoid ellipses"),
    "commas_per_sentence": ("punctuation", "Use comma-rich, flowing sentences", "Keep commas to a minimum"),
    "dashes_per_sentence": ("punctuation", "Use dashes for asides", "Avoid dashes"),
    "has_emoji": ("emoji", "Include an emoji", "Do not use emoji"),
    "emoji_end": ("emoji", "Put emoji at the end of the message", "Do not end with an emoji"),
    "emoji_lead": ("emoji", "Lead with an emoji", "Do not open with an emoji"),
    "all_lowercase": ("register", "Write in all lowercase", "Use standard capitalisation"),
    "contraction_rate": ("register", "Use contractions (I'm, we'll, don't)", "Avoid contractions"),
    "uncontracted_forms": ("register", "Prefer full forms (I am, do not)", "Contract where natural"),
    "hedge_rate": ("pragmatics", "Soften claims with hedges (maybe, I think)", "State things directly without hedging"),
    "booster_rate": ("pragmatics", "Use emphatic boosters (definitely, really)", "Avoid boosters"),
    "intensifier_rate": ("affect", "Intensify (so, super, really)", "Avoid intensifiers"),
    "discourse_marker_rate": ("dialogue", "Use conversational markers (so, well, anyway)", "Avoid filler markers"),
    "textese_rate": ("register", "Use casual chat forms (haha, yeah, cool)", "Avoid chat slang"),
    "pronoun_first_singular": ("register", "Speak as 'I'", "Avoid 'I'"),
    "pronoun_first_plural": ("register", "Speak as 'we'", "Avoid 'we'"),
    "pronoun_second": ("register", "Address the reader as 'you' often", "Use 'you' sparingly"),
    "addresses_by_name_first": ("dialogue", "Open by addressing the reader by name", "Do not open with the reader's name"),
    "opens_with_name": ("dialogue", "Open by addressing the reader by name", "Do not open with the reader's name"),
    "emoji_count": ("emoji", "Use several emoji", "Use emoji sparingly"),
    "lowercase_sentence_starts": ("register", "Start sentences in lowercase", "Capitalise sentence starts"),
    "social_offer": ("pragmatics", "Offer further help", "Do not offer further help unprompted"),
    "social_thank": ("pragmatics", "Thank the other person", "Rarely say thanks"),
    "social_apologise": ("pragmatics", "Apologise readily", "Rarely apologise"),
    "social_greet": ("pragmatics", "Greet the other person", "Skip greetings"),
    "social_reassure": ("pragmatics", "Reassure the other person", "Rarely reassure"),
    "social_empathise": ("pragmatics", "Acknowledge how the other person feels", "Stay matter-of-fact about feelings"),
    "social_close": ("pragmatics", "Close with a sign-off", "Skip sign-offs"),
    "social_request": ("pragmatics", "Ask the other person to do things", "Rarely make requests"),
    "social_refuse": ("pragmatics", "Say no plainly when needed", "Rarely refuse"),
    "formality_fscore": ("register", "Write formally (noun- and preposition-heavy)", "Write informally (verb- and pronoun-heavy)"),
    "sentiment_score": ("affect", "Keep the tone warm and positive", "Keep the tone sober and concerned rather than upbeat"),
    "lexical_density": ("syntax", "Pack sentences with content words", "Use light, easy sentences"),
    "imperative_sentence_rate": ("syntax", "Use direct instructions", "Avoid commands"),
    "passive_sentence_rate": ("syntax", "Use the passive voice", "Use the active voice"),
    "length_ratio": ("dialogue", "Reply at greater length than the message received", "Reply more briefly than the message received"),
    "lsm": ("dialogue", "Mirror the other person's style", "Keep your own style regardless of the other person"),
    "asks_back": ("dialogue", "Answer a question with a question back", "Answer without asking back"),
    "uk_spelling": ("lexical", "Use British spelling", "Avoid British spelling"),
}
# What a dialogue act says in a rule: wording for more of it, wording for less.
ACT_TEXT = {
    "ask": ("Ask questions of the other person", "Rarely ask questions"),
    "ask_yes_no": ("Ask yes/no questions", "Avoid yes/no questions"),
    "answer": ("Answer directly", "Respond with more than a bare answer"),
    "acknowledge": ("Acknowledge what was said before moving on", "Move on without a separate acknowledgement"),
    "backchannel": ("Use short backchannels (ok, got it)", "Avoid bare backchannels"),
    "exclaim": ("Use exclamations", "Avoid exclamations"),
    "say": ("Make plain statements", "Avoid flat statements"),
    "reply_yes": ("Say yes readily", "Rarely give a bare yes"),
    "reply_no": ("Say no plainly", "Rarely give a bare no"),
    "hold": ("Buy time before answering (let me check)", "Answer without holding"),
    "intent": ("State what you will do next", "Rarely announce next steps"),
}
# Features of the portable scorer, and those it takes the logarithm of.
PORTABLE = [
    "words", "words_per_sentence", "mean_word_length", "long_word_rate", "is_fragment", "exclamations_per_sentence",
    "questions_per_sentence", "ends_with_question", "ends_with_exclamation", "ends_without_punctuation", "ellipses_per_sentence",
    "multi_exclamation", "commas_per_sentence", "dashes_per_sentence", "has_emoji", "emoji_end", "emoji_lead", "emoticons",
    "all_lowercase", "lowercase_sentence_starts", "capitalised_words_rate", "contraction_rate", "uncontracted_forms",
    "hedge_rate", "booster_rate", "intensifier_rate", "discourse_marker_rate", "textese_rate", "pronoun_first_singular",
    "pronoun_first_plural", "pronoun_second", "addresses_by_name_first", "line_breaks",
]
LOG_FEATURES = ("words", "line_breaks", "emoticons")
