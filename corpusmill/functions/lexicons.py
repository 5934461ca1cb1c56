"""Word lists, weights and patterns that results depend on, as plain text. Patterns know only what RE2 knows; `\\b`, `\\d` and `\\s` are ASCII."""

from __future__ import annotations

#: Words by which the simple detector tells languages, in the order that breaks ties.
SIMPLE_LANGUAGE = {
    "en": "the and is in to of a that it with".split(),
    "es": "el la de que y a en un es se".split(),
    "fr": "le de et à un il être en avoir".split(),
    "de": "der die und in den von zu das mit sich".split(),
}

#: The scored detector: common words, further stop words (all common ones are stop words too), letter shares, and frequent word pairs.
LANGUAGE = {
    "en": {
        "common": "the and to of a in is it you that he was for on are as with his they at".split(),
        "stop": "be this have from or one had by words".split(),
        "letters": {"e": 0.127, "t": 0.091, "a": 0.082, "o": 0.075, "i": 0.070, "n": 0.067, "s": 0.063, "h": 0.061, "r": 0.060, "d": 0.043},
        "pairs": ["of the", "in the", "to the", "on the", "for the", "and the", "to be", "in a", "that the", "with the"],
    },
    "es": {
        "common": "el la de que y a en un es se no te lo le da su por son con para".split(),
        "stop": "una del las los al como pero sus".split(),
        "letters": {"e": 0.138, "a": 0.125, "o": 0.086, "s": 0.080, "r": 0.069, "n": 0.067, "i": 0.063, "d": 0.058, "l": 0.050, "c": 0.047},
        "pairs": ["de la", "en el", "de los", "en la", "que el", "por la", "con la", "de un", "en un", "que la"],
    },
    "fr": {
        "common": "le de et à un il être en avoir que pour dans ce son une sur avec ne se".split(),
        "stop": "pas tout plus par grand ou mais du au".split(),
        "letters": {"e": 0.121, "s": 0.081, "a": 0.076, "r": 0.066, "n": 0.061, "t": 0.059, "i": 0.059, "u": 0.056, "l": 0.054, "o": 0.054},
        "pairs": ["de la", "de le", "à la", "dans le", "pour la", "sur le", "avec le", "que le", "par la", "de ce"],
    },
    "de": {
        "common": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als".split(),
        "stop": "auch es an werden aus er hat dass sie".split(),
        "letters": {"e": 0.174, "n": 0.098, "i": 0.075, "s": 0.073, "r": 0.070, "a": 0.065, "t": 0.061, "d": 0.051, "h": 0.048, "u": 0.043},
        "pairs": ["der die", "in der", "von der", "zu der", "mit der", "auf der", "für die", "in den", "von den", "zu den"],
    },
    "it": {
        "common": "il di che e la per un in con del da a al le si dei come io lo tutto".split(),
        "stop": "ma se era lei mio quello o ci anche".split(),
        "letters": {"e": 0.119, "a": 0.117, "i": 0.113, "o": 0.098, "n": 0.069, "t": 0.063, "r": 0.064, "l": 0.065, "s": 0.050, "c": 0.045},
        "pairs": [],
    },
    "pt": {
        "common": "de a o e da em um para é com não uma os no se na por mais as dos".split(),
        "stop": "como mas foi ao ele das tem à seu".split(),
        "letters": {"a": 0.146, "e": 0.126, "o": 0.103, "s": 0.078, "r": 0.065, "i": 0.062, "n": 0.050, "d": 0.050, "m": 0.047, "u": 0.046},
        "pairs": [],
    },
}

#: Weights of the words of the ratio model.
POSITIVE = {"good": 1.0, "great": 1.2, "excellent": 1.5, "amazing": 1.4, "wonderful": 1.3, "fantastic": 1.4, "awesome": 1.3, "outstanding": 1.5, "perfect": 1.4, "brilliant": 1.3, "positive": 1.0, "happy": 1.1, "love": 1.2, "best": 1.3, "better": 0.8, "success": 1.1, "successful": 1.1, "achieve": 0.9, "achievement": 1.0, "win": 1.0, "winner": 1.1}
NEGATIVE = {"bad": 1.0, "terrible": 1.4, "awful": 1.3, "horrible": 1.3, "worst": 1.4, "hate": 1.2, "negative": 1.0, "problem": 0.8, "issue": 0.7, "error": 0.9, "fail": 1.1, "failure": 1.2, "wrong": 0.8, "difficult": 0.7, "hard": 0.6, "impossible": 1.1, "sad": 1.0, "angry": 1.1, "disappointed": 1.0, "frustrating": 0.9}
EMOTIONS = {
    "joy": {"happy": 1.0, "joy": 1.0, "excited": 0.9, "pleased": 0.8, "delighted": 0.9, "cheerful": 0.8, "thrilled": 1.0, "elated": 0.9},
    "anger": {"angry": 1.0, "mad": 0.9, "furious": 1.0, "irritated": 0.7, "annoyed": 0.6, "outraged": 1.0, "livid": 0.9, "irate": 0.8},
    "fear": {"afraid": 1.0, "scared": 0.9, "terrified": 1.0, "nervous": 0.7, "anxious": 0.8, "worried": 0.6, "fearful": 0.9, "panic": 1.0},
    "sadness": {"sad": 1.0, "depressed": 0.9, "miserable": 1.0, "unhappy": 0.8, "sorrowful": 0.9, "melancholy": 0.8, "grief": 1.0, "despair": 1.0},
    "analytical": {"analyze": 1.0, "research": 0.9, "study": 0.8, "examine": 0.9, "investigate": 0.9, "logical": 0.8, "systematic": 0.9, "methodical": 0.8},
    "confident": {"confident": 1.0, "certain": 0.9, "sure": 0.8, "convinced": 0.9, "determined": 0.8, "assertive": 0.9, "bold": 0.8, "decisive": 0.9},
    "tentative": {"maybe": 0.8, "perhaps": 0.7, "possibly": 0.7, "uncertain": 0.9, "doubtful": 0.8, "hesitant": 0.9, "unsure": 0.8, "tentative": 1.0},
    "openness": {"open": 0.8, "curious": 0.9, "interested": 0.8, "explore": 0.9, "discover": 0.8, "learn": 0.7, "innovative": 0.9, "creative": 0.8},
}
TOPICS = {
    "technology": "software computer digital internet web application system data programming code".split(),
    "business": "company market sales revenue profit customer product service strategy management".split(),
    "finance": "money bank investment stock financial budget cost price economic currency".split(),
    "health": "medical doctor patient hospital treatment disease health medicine care therapy".split(),
    "education": "school student teacher university learning education study knowledge academic research".split(),
    "legal": "law legal court judge attorney contract regulation compliance policy rights".split(),
    "science": "research study experiment analysis scientific theory hypothesis data method result".split(),
    "politics": "government political policy election vote democracy parliament senator congress legislation".split(),
}

#: The sentence lexicon of sentiment; negative words have negative scores.
SENTIMENT = {
    **{"amazing": 0.8, "awesome": 0.9, "beautiful": 0.7, "best": 0.8, "brilliant": 0.8, "excellent": 0.9, "fantastic": 0.8, "good": 0.6, "great": 0.7, "happy": 0.7, "incredible": 0.8, "love": 0.8, "perfect": 0.9, "wonderful": 0.8, "outstanding": 0.9, "superb": 0.8, "marvelous": 0.8, "exceptional": 0.9, "magnificent": 0.8, "delightful": 0.7, "enjoy": 0.6, "like": 0.5, "pleased": 0.6, "satisfied": 0.6, "positive": 0.6, "success": 0.7, "win": 0.7, "victory": 0.8},
    **{"awful": -0.8, "bad": -0.6, "terrible": -0.9, "horrible": -0.9, "disgusting": -0.8, "hate": -0.8, "dislike": -0.6, "sad": -0.6, "angry": -0.7, "furious": -0.9, "annoyed": -0.6, "disappointed": -0.7, "frustrated": -0.7, "upset": -0.7, "worried": -0.6, "concerned": -0.5, "problem": -0.5, "issue": -0.5, "error": -0.6, "failure": -0.7, "wrong": -0.5, "broken": -0.6, "fail": -0.7, "lose": -0.6, "worst": -0.9, "useless": -0.7, "worthless": -0.8, "pathetic": -0.8},
}
INTENSIFIERS = {"very": 1.5, "extremely": 2.0, "incredibly": 1.8, "absolutely": 1.7, "completely": 1.6, "totally": 1.5, "really": 1.3, "quite": 1.2, "pretty": 1.2, "rather": 1.1, "somewhat": 0.8, "slightly": 0.7, "highly": 1.4, "deeply": 1.4, "truly": 1.3, "genuinely": 1.3}
NEGATORS = "not no never none nobody nothing neither nowhere hardly barely scarcely seldom rarely without lack don't doesn't didn't won't wouldn't can't cannot shouldn't couldn't mustn't isn't aren't wasn't weren't".split()
#: Those in lower case, as the text they are sought in.
EMOTICONS = {":)": 0.5, ":-)": 0.5, ";)": 0.6, ";-)": 0.6, "<3": 0.8, "♥": 0.8, ":(": -0.5, ":-(": -0.5, ":'(": -0.7, ":,(": -0.7, ":/": -0.3, ":-/": -0.3, ":@": -0.7, ":|": -0.2, ":-|": -0.2, ">:(": -0.8}

#: Patterns of each kind of entity, and the words that make one more certain wherever they stand.
ENTITIES = {
    "email": [r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b"],
    "url": [r"https?://[^\s<>\"{}|\\^`\[\]]+", r"www\.[^\s<>\"{}|\\^`\[\]]+", r"ftp://[^\s<>\"{}|\\^`\[\]]+"],
    "phone": [r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b", r"\b\(\d{3}\)\s?\d{3}[-.]?\d{4}\b", r"\b\+?1[-.]?\d{3}[-.]?\d{3}[-.]?\d{4}\b"],
    "credit_card": [r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b5[1-5]\d{2}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", r"\b3[47]\d{2}[-\s]?\d{6}[-\s]?\d{5}\b", r"\b6011[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b"],
    "ssn": [r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b"],
    "ip_address": [r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"],
    "date": [r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b\d{1,2}-\d{1,2}-\d{2,4}\b", r"\b\d{4}-\d{1,2}-\d{1,2}\b", r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+\d{1,2},?\s+\d{4}\b"],
    "money": [r"\$\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b", r"\b\d{1,3}(?:,\d{3})*(?:\.\d{2})?\s*(?:USD|usd|dollars?)\b", r"\b(?:USD|usd|\$)\s*\d{1,3}(?:,\d{3})*(?:\.\d{2})?\b"],
    "percentage": [r"\b\d{1,3}(?:\.\d{1,2})?%\b", r"\b\d{1,3}(?:\.\d{1,2})?\s*percent\b"],
    "person": [r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b", r"\b(?:Mr|Mrs|Ms|Dr|Prof)\.?\s+[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?\b"],
    "organization": [r"\b[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*\s+(?:Inc|Corp|LLC|Ltd|Co|Company|Corporation|Group|Enterprises?)\.?\b", r"\b[A-Z][a-z]*(?:\s+[A-Z][a-z]*)*\s+(?:University|College|Institute|School|Hospital|Bank|Insurance)\b"],
    "location": [r"\b[A-Z][a-z]+,\s*[A-Z]{2}\b", r"\b[A-Z][a-z]+\s+[A-Z][a-z]+,\s*[A-Z]{2}\b", r"\b\d{5}(?:-\d{4})?\b"],
}
ENTITY_CONTEXT = {
    "phone": ["phone", "telephone", "mobile", "cell", "contact", "call", "number"],
    "email": ["email", "e-mail", "contact", "reach", "send", "mail"],
    "credit_card": ["credit card", "payment", "card number", "billing", "charge"],
    "ssn": ["ssn", "social security", "social security number", "social"],
    "person": ["mr", "mrs", "ms", "dr", "prof", "person", "individual", "name"],
}
#: The seven kinds of the model's entity list, with their confidence.
MODEL_ENTITIES = {
    "EMAIL": r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}",
    "PHONE": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b|\(\d{3}\)\s?\d{3}[-.]?\d{4}",
    "URL": r"https?://[^\s]+",
    "PERSON": r"\b[A-Z][a-z]+\s+[A-Z][a-z]+\b",
    "ORG": r"\b[A-Z][a-zA-Z]*\s+(?:Inc|Corp|LLC|Ltd|Company|Corporation)\b",
    "MONEY": r"\$\d+(?:,\d{3})*(?:\.\d{2})?",
    "DATE": r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b|\b\d{4}-\d{2}-\d{2}\b",
}

#: Phrases that make a text sensitive, and terms of health.
SENSITIVE = ["confidential", "classified", "secret", "restricted", "ssn", "social security", "credit card", "password", "medical record", "patient", "health information", "financial", "bank account", "routing number"]
HEALTH = ["patient", "medical", "diagnosis", "treatment", "medication", "health record", "medical record", "hospital", "clinic", "doctor"]

#: Rules of the sensitivity levels, highest first: threshold, patterns with score times weight, and what personal data adds:
#: least number of findings, types that must all be there, the bonus for that, and types that add half their confidence.
SENSITIVITY_LEVELS = {
    "top_secret": (0.9, [(r"(?i)(top\s+secret|\bts\b|classification:\s*top\s*secret)", 1.0), (r"(?i)(national\s+security|defense\s+intelligence|military\s+classified)", 0.72)], (3, ["ssn", "passport", "security_clearance"], 0.8, ["security_clearance", "classified_access"])),
    "restricted": (0.7, [(r"(?i)(restricted|classification:\s*restricted)", 0.8), (r"(?i)(trade\s+secret|proprietary|confidential\s+financial)", 0.49)], (2, ["ssn", "credit_card"], 0.6, ["ssn", "passport", "credit_card"])),
    "confidential": (0.5, [(r"(?i)(confidential|classification:\s*confidential)", 0.6), (r"(?i)(medical\s+record|patient\s+information|health\s+record)", 0.56)], (1, ["email", "phone", "name"], 0.4, ["ssn", "credit_card", "medical_id"])),
    "internal": (0.3, [(r"(?i)(internal\s+use|company\s+confidential|internal\s+only)", 0.4)], (0, [], 0.2, [])),
    "public": (0.0, [], (0, [], 0.0, [])),
}
RULE_PII = {"ssn": r"\b\d{3}-\d{2}-\d{4}\b", "credit_card": r"\b4\d{3}[-\s]?\d{4}[-\s]?\d{4}[-\s]?\d{4}\b", "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "phone": r"\b\d{3}[-.]?\d{3}[-.]?\d{4}\b"}
#: Classes of data: patterns, keywords, context words, risk.
DATA_CLASSES = {
    "financial": ([r"\$\d+", r"\d+\.\d{2}"], ["bank", "account", "payment", "financial", "money", "credit"], ["transaction", "invoice", "statement"], "high"),
    "medical": ([r"(?i)patient\s+[0-9A-Za-z_]+"], ["patient", "medical", "health", "diagnosis", "treatment"], ["hospital", "clinic", "doctor", "physician"], "high"),
    "personal": ([r"(?i)name:\s*[0-9A-Za-z_]+"], ["name", "address", "personal", "contact", "individual"], ["profile", "contact", "identity"], "medium"),
}
#: Frameworks: phrases, types of personal data, classes of data that bring each about.
FRAMEWORKS = {
    "GDPR": (["personal data", "eu citizen", "european union"], ["email", "name", "phone"], ["personal", "contact"]),
    "HIPAA": (["health information", "medical record", "patient data"], ["medical_id", "health_record"], ["medical", "health"]),
    "PCI": (["payment card", "credit card", "cardholder data"], ["credit_card", "payment_info"], ["payment", "financial"]),
}

#: Linguistic analyser: marks of style, thought and tone, sought as substrings.
FORMAL = ["however", "therefore", "furthermore", "consequently", "nevertheless"]
INFORMAL = ["yeah", "ok", "cool", "awesome", "stuff"]
ABSTRACT = ["freedom", "justice", "beauty", "truth", "love", "hate", "fear", "happiness", "sadness", "anger", "joy", "hope", "despair", "concept", "idea", "theory", "principle", "belief", "value"]
TONE_GOOD = ["good", "great", "excellent", "amazing", "wonderful", "happy", "joy"]
TONE_BAD = ["bad", "terrible", "awful", "sad", "angry", "hate", "fear"]
SUBJECTIVE = ["think", "believe", "feel", "opinion", "personally", "maybe", "probably"]
OBJECTIVE = ["fact", "data", "evidence", "research", "study", "analysis"]
CONJUNCTIONS = ["and", "or", "but", "so", "yet", "for", "nor", "because", "since", "although"]
ANALYSER_STOP = "the and to of a in is it you that he was for on are as with his they at be this have from or one had by words but not what all were they we when your can said".split()
#: By the language found; other languages take the English ones.
ANALYSER_STOPS = {
    "en": ANALYSER_STOP,
    "es": "el la de que y a en un es se no te lo le da su por son con para".split(),
    "fr": "le de et à un il être et en avoir que pour dans ce son une sur avec ne se".split(),
}
PHRASE_STOP = "the a an and or but in on at to for of with by is are was were be been have has had do does did will would could should this that these those i you he she it we they them".split()
#: Words that keywords leave out, and common ones that count for less; both are parameters of the operator.
KEYWORD_STOP = "a an and are as at be by for from has he in is it its of on that the to was were will with this but they have had what said each which she do how their if up out many then them these so some her would make like into him more go no way could my than first been call who now find long down day did get come made may part over new sound take only little work know".split()
KEYWORD_COMMON = "said can get would make know will people time way could see first been call who its now find long down day did come made may part over new sound take only little work".split()
TOPIC_SEEDS = {
    "Technology": "computer software hardware technology digital internet data programming code algorithm system network database server cloud artificial intelligence machine learning automation platform application development".split(),
    "Business": "business company corporate management strategy revenue profit sales marketing customer client market finance financial investment budget cost price commercial enterprise organization operations growth".split(),
    "Health": "health medical healthcare patient doctor hospital treatment medicine therapy diagnosis disease clinic pharmaceutical drug medication surgery wellness fitness mental physical nutrition prevention care recovery".split(),
    "Education": "education school university college student teacher learning study course curriculum academic research knowledge training instruction classroom degree program scholarship educational pedagogy textbook examination".split(),
    "Finance": "finance financial money bank banking investment loan credit debt insurance portfolio asset liability equity bond stock market trading capital fund budget accounting tax economic".split(),
    "Legal": "legal law court judge lawyer attorney case lawsuit litigation contract agreement regulation compliance statute legislation jurisdiction precedent constitutional criminal civil judicial proceedings".split(),
    "Science": "science research experiment hypothesis theory study analysis scientific laboratory method data results conclusion evidence observation measurement biology chemistry physics mathematics statistics publication".split(),
    "Security": "security cybersecurity protection privacy encryption authentication authorization firewall vulnerability threat risk attack breach malware virus hacking secure compliance audit monitoring incident response defense".split(),
    "Communication": "communication message email phone meeting conference presentation discussion conversation dialogue notification announcement broadcast social media network channel platform interface interaction collaboration feedback".split(),
    "Project Management": "project management planning schedule timeline milestone deadline task assignment resource allocation budget scope requirement deliverable stakeholder team coordination tracking progress status report workflow process".split(),
}
