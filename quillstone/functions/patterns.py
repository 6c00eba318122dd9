"""Patterns, word lists, labels and thresholds that results depend on."""

ATTRIBUTES = ("age", "location", "occupation", "education")

# Thresholds and band edges.
MEDIUM_EDGE, HIGH_EDGE = 0.30, 0.60
CUE_FLOOR, MOST_CUES = 0.20, 5
NOISE_FLOOR, CAPACITY_FLOOR = 0.05, 1.50
UTILITY_FLOOR = 0.70
RULE_STEPS = (0.05, 0.45, 0.75, 0.95)

# Explicit identifiers, in the order in which they are redacted.
EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONE = r"\b(?:\+?\d{1,3}[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b"
SSN = r"\b\d{3}-\d{2}-\d{4}\b"
IP = r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
URL = r"https?://\S+|www\.\S+"
DATE = r"\b(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4})\b"
PERSON_LEAD, PERSON_NAME = r"\b(?:My name is|I am|This is)\s+", r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)?"
PLACE_LEAD, PLACE_NAME = r"\b(?:living in|moved to|commute to|located in|from|in)\s+", r"[A-Z][a-z]+(?:,\s*[A-Z]{2})?"
EXPLICIT = {
    "EMAIL": EMAIL,
    "PHONE": PHONE,
    "SSN": SSN,
    "IP": IP,
    "URL": URL,
    "DATE": DATE,
    "PERSON": f"{PERSON_LEAD}({PERSON_NAME})\\b",
    "LOCATION": f"{PLACE_LEAD}({PLACE_NAME})\\b",
}
HARD_SCRUB = (("[EMAIL]", EMAIL), ("[PHONE]", PHONE), ("[IP_ADDRESS]", IP), ("[URL]", URL))

# Indirect markers of the hardness classes.
INDIRECT = (
    r"\b(?:altitude|mile high|front range|rockies|red rocks)\b",
    r"\b(?:space needle|rainier|sound transit|pike place)\b",
    r"\b(?:silicon valley|bart|caltrain|bay area)\b",
    r"\b(?:the tube|oyster card|borough|m25)\b",
    r"\b(?:junior year|undergrad|dissertation|advisor|postdoc)\b",
    r"\b(?:on call|attending physician|rounds|scrubs)\b",
    r"\b(?:pull request|code review|sprint|standup|prod deployment)\b",
    r"\b(?:in my 20s|when I was a kid in the 90s|retirement plan)\b",
)

# Cue patterns of the rule risk score, matched on lower-cased text.
RULE_CUES = {
    "age": (
        r"\b\d{1,2}[-\s]*(?:years?[-\s]*old|yo|y/o)\b",
        r"\b(?:in my (?:20s|30s|40s|50s|60s|70s|twenties|thirties|forties))\b",
        r"\b(?:retired|pensioner|high school|college student|freshman|sophomore)\b",
    ),
    "location": (
        r"\b(?:living in|moved to|commute to|transit in|downtown|suburbs of)\b",
        r"\b(?:denver|seattle|austin|california|new york|boston|chicago|london|berlin|paris|tokyo|pittsburgh|san francisco)\b",
        r"\b(?:[A-Z]{2}\b|\bco\b|\bwa\b|\btx\b|\bca\b|\bny\b)",
    ),
    "occupation": (
        r"\b(?:work as|employed at|my boss|colleagues|software engineer|nurse|doctor|teacher|barista|lawyer)\b",
        r"\b(?:tech company|startup|hospital|clinic|law firm|school district|consultancy)\b",
        r"\b(?:grading papers|grading exams)\b",
    ),
    "education": (
        r"\b(?:bachelor'?s?|master'?s?|ph\.?d\.?|degree in|undergrad|grad school|alumni|major in)\b",
        r"\b(?:university of|college of|mit|stanford|harvard|berkeley|carnegie mellon)\b",
    ),
}
PRESENCE_CUES = {
    "age": (
        r"\b\d{1,2}\s*(?:years old|yo|y/o)\b",
        r"\b(?:in my (?:20s|30s|40s|50s|60s|70s|twenties|thirties|forties))\b",
        r"\b(?:retired|pensioner|high school|college student|freshman|sophomore)\b",
    ),
    "location": (
        r"\b(?:living in|moved to|commute to|transit in|downtown|suburbs of)\b",
        r"\b(?:denver|seattle|austin|california|new york|boston|chicago|london|berlin|paris|tokyo|montreal|atlanta)\b",
        r"\b(?:[A-Z]{2}\b|\bco\b|\bwa\b|\btx\b|\bca\b|\bny\b)",
    ),
    "occupation": (
        r"\b(?:work as|employed at|my boss|colleagues|software engineer|nurse|doctor|teacher|barista|lawyer|psychologist)\b",
        r"\b(?:tech company|startup|hospital|clinic|law firm|school district|consultancy)\b",
    ),
    "education": (
        r"\b(?:bachelor'?s?|master'?s?|ph\.?d\.?|degree in|undergrad|grad school|alumni|major in)\b",
        r"\b(?:university of|college of|mit|stanford|harvard|berkeley|carnegie mellon)\b",
    ),
}
FALLBACK_CUES = {
    "location": ("green line", "seattle", "denver", "boston", "bay area", "subway", "transit"),
    "occupation": ("co-op", "internship", "software engineer", "accountant", "nurse", "residency"),
    "education": ("campus", "undergraduate", "grad student", "thesis", "dorm", "tuition"),
    "age": ("freshman", "20s", "retirement", "pension", "grandkids"),
}

# First-person tests and the indirect boosts of the blended score.
SELF_WORDS = r"\b(i|i'm|i am|my|me|myself|mine|we|our|ours|us|i've|i'd|i'll)\b"
SELF_PHRASES = r"\b(?:living in|commute to|working as|graduated from|started my career|my job|my role|my co-op)\b"
BOOSTS = (
    ("location", 0.55, r"\b(?:green line|red line|orange line|blue line|silver line|mbta|sound transit|bart|caltrain)\b"),
    ("occupation", 0.50, r"\b(?:co-op|intern|internship|residency|resident|charge nurse)\b"),
    ("education", 0.50, r"\b(?:campus|coursework|dorm|undergraduate|thesis|dissertation|doctoral committee)\b"),
    ("age", 0.50, r"\b(?:started my (?:it\s+)?career back in|after \d{1,2} years (?:of|in)|before retirement)\b"),
)
OTHERS_AGE = r"\b(?:diagnose|patient|child|son|daughter|infant|toddler)\b.*?\b\d{1,2}[-\s]*years?[-\s]*old\b"
OWN_AGE = r"\b(?:i am|i'm|in my)\s+\d{1,2}\b"

# Neutralising replacements, in order, case-insensitive.
AGE_PHRASE = r"\d{1,2}[-\s]*(?:years?[-\s]*old|yo|y/o)|in my (?:20s|30s|40s|50s|60s|twenties|thirties|forties)"
CITIES = "Pittsburgh|Denver|Seattle|Austin|New York|Boston|Chicago|San Francisco|London|Paris|Tokyo"
CITY_TAIL = r"(?:,\s*(?:[A-Za-z]{4,}|[A-Z]{2}))?"
ROLES = "software engineer|lawyer|doctor|nurse|barista|consultant|designer|engineer|teacher"
NEUTRAL = {
    "age": (
        (rf"\b(?:{AGE_PHRASE})\b", "an adult"),
        (r"\b(?:retired|pensioner)\b", "not working"),
        (r"\ba\s+an\s+adult\b", "an adult"),
    ),
    "location": (
        (rf"\b(?:in|to|from|near|around)\s+(?:{CITIES}){CITY_TAIL}\b", "locally"),
        (rf"\b(?:{CITIES}){CITY_TAIL}\b", "the area"),
    ),
    "occupation": (
        (rf"\b(?:work as|employed as|employed at|working as)\s+(?:a\s+|an\s+|my\s+)?(?:{ROLES})\b", "work in a professional role"),
        (r"\b(?:internship in|intern at)\s+(?:a\s+|an\s+|my\s+)?(?:tech|engineering|medicine|law|consulting|design|education|summer internship)\b", "work in a professional role"),
        (rf"\b(?:{ROLES})\b", "professional"),
        (r"\b(?:summer\s+internship|internship|intern)\b", "role"),
        (r"\b(?:tech startup|startup|tech company|firm|clinic|hospital)\b", "company"),
        (r"\b(?:grading papers|grading exams)\b", "evaluating work"),
    ),
    "education": (
        (
            r"\b(?:undergrad at|attending|student at|degree from|graduated from)\s+(?:college|university|(?:[A-Z][a-zA-Z]*(?:\s+[A-Z][a-zA-Z]*)*\s+(?:University|College|Institute))|(?:MIT|CMU|Stanford|Harvard|Berkeley|Carnegie Mellon))\b",
            "completing higher education",
        ),
        (r"\b(?:bachelor'?s?|master'?s?|ph\.?d\.?|doctorate)(?:\s+degree)?\b", "degree"),
        (r"\b(?:undergrad|college student|Carnegie Mellon|MIT|Stanford|Harvard|Berkeley)\b", "higher education"),
    ),
}
PLACEHOLDERS = (
    (rf"\b(?:{AGE_PHRASE})\b", "[AGE]"),
    (rf"\b(?:{CITIES}){CITY_TAIL}\b", "[LOCATION]"),
    (rf"\b(?:{ROLES}|summer internship|internship|intern)\b", "[OCCUPATION]"),
    (r"\b(?:undergrad|Carnegie Mellon|MIT|Stanford|Harvard|Berkeley)\b", "[EDUCATION]"),
)

# Negations of the two lexical entailment variants.
NEGATIONS_A = ("not", "never", "no", "neither", "nor", "none", "cannot", "hardly")
NEGATIONS_B = ("not", "never", "no", "neither", "nor", "none", "nobody", "nowhere")

# Labels of each attribute, in order.
TAXONOMY = {
    "age": ("18-24", "25-34", "35-44", "45-54", "55+"),
    "education": ("high_school", "college", "master", "phd"),
    "occupation": ("student", "technology", "healthcare", "education_academic", "business_finance", "service_retail", "other"),
    "location": ("us_northeast", "us_midwest", "us_south", "us_west", "uk_europe", "canada", "asia_pacific", "other_global"),
}

# Ordered keyword cascades from free text to labels; the last entry of each is the default.
CASCADE_EVAL = {
    "education": (
        ("phd", ("phd", "ph.d", "doctor", "doctoral", "postdoc")),
        ("master", ("master", "msc", "mba", "postgraduate", "jd", "md")),
        ("college", ("bachelor", "undergraduate", "college", "university", "bs", "ba")),
        ("high_school", ()),
    ),
    "occupation": (
        ("student", ("student", "intern", "co-op")),
        ("technology", ("software", "developer", "engineer", "tech", "programmer", "data", "it")),
        ("healthcare", ("doctor", "nurse", "physician", "psycholog", "clinic", "health")),
        ("education_academic", ("teacher", "professor", "academic", "educat", "school")),
        ("business_finance", ("finance", "bank", "account", "manager", "business", "analyst")),
        ("service_retail", ("retail", "service", "barista", "waiter", "sales")),
        ("other", ()),
    ),
    "location": (
        ("canada", ("canada", "montreal", "toronto", "vancouver")),
        ("uk_europe", ("uk", "london", "england", "europe", "germany", "france", "berlin", "paris")),
        ("asia_pacific", ("asia", "japan", "tokyo", "china", "pacific", "australia", "thailand", "bangkok", "singapore", "india")),
        ("us_northeast", ("ny", "new york", "boston", "massachusetts", "northeast")),
        ("us_west", ("wa", "seattle", "ca", "california", "colorado", "denver", "west")),
        ("us_midwest", ("chicago", "illinois", "midwest", "ohio")),
        ("us_south", ("tx", "texas", "austin", "atlanta", "georgia", "south")),
        ("other_global", ()),
    ),
}
#: The training variant has a shorter list for Asia.
ASIA_TRAIN = ("asia", "japan", "tokyo", "china", "pacific", "australia")
CASCADE_PROMPT = {
    "education": (
        ("phd", ("phd", "ph.d", "doctor", "doctoral", "dphil")),
        ("master", ("master", "msc", "mba", "ma ", "ms ", "m.s", "m.a", "postgrad")),
        ("college", ("bachelor", "college", "undergrad", "bsc", "b.s", "b.a", "university", "degree")),
        ("high_school", ("high school", "secondary", "hs diploma", "ged")),
        ("college", ()),
    ),
    "occupation": (
        ("student", ("student", "undergrad", "pupil")),
        ("technology", ("engineer", "developer", "software", "programmer", "it ", "data scientist", "tech")),
        ("healthcare", ("nurse", "doctor", "physician", "medical", "health", "psycholog", "psychiat", "therap", "dentist")),
        ("education_academic", ("professor", "teacher", "lecturer", "researcher", "academic", "phd student")),
        ("business_finance", ("consultant", "manager", "finance", "account", "banker", "analyst", "business", "marketing", "sales")),
        ("service_retail", ("retail", "cashier", "waiter", "waitress", "barista", "server", "clerk", "service")),
        ("other", ()),
    ),
    "location": (
        ("us_northeast", ("boston", "new york", "massachusetts", "connecticut", "philadelphia", "atlanta", "washington", "maine", "vermont", "new jersey")),
        ("us_west", ("seattle", "california", "san francisco", "los angeles", "portland", "denver", "arizona", "nevada", "oregon", "washington state")),
        ("us_south", ("texas", "florida", "miami", "houston", "dallas", "austin", "georgia", "tennessee", "louisiana", "carolina")),
        ("us_midwest", ("chicago", "ohio", "michigan", "illinois", "minnesota", "wisconsin", "indiana", "missouri", "kansas")),
        ("canada", ("canada", "toronto", "vancouver", "montreal", "ottawa", "calgary")),
        ("uk_europe", ("london", "england", "uk", "united kingdom", "france", "germany", "spain", "italy", "paris", "berlin", "europe", "netherlands", "sweden")),
        ("asia_pacific", ("bangkok", "thailand", "tokyo", "japan", "china", "singapore", "india", "australia", "korea", "sydney", "hong kong", "asia")),
        ("other_global", ()),
    ),
}

# Ordered keywords of the label-level fallback attacker.
ATTACK_LABELS = {
    "location": (("us_west", ("denver", "seattle", "sound transit")), ("us_northeast", ("boston", "green line", "cambridge"))),
    "occupation": (("technology", ("software engineer", "amazon", "tech", "coding")), ("student", ("student", "co-op", "campus"))),
    "education": (("college", ("undergraduate", "co-op", "campus")), ("phd", ("phd", "grad student", "thesis"))),
    "age": (("18-24", ("co-op", "campus", "freshman")),),
}
# Ordered markers of the free-text fallback attacker; state codes count after "City, ".
ATTACK_PLACES = (
    ("Denver", ("denver", "mile high", "red rocks", "front range"), "co"),
    ("Seattle", ("seattle", "space needle", "pike place", "sound transit", "rainier"), "wa"),
    ("Austin", ("austin", "texas capital"), "tx"),
    ("New York", ("new york", "nyc", "manhattan", "brooklyn", "mta"), "ny"),
    ("San Francisco", ("san francisco", "bay area", "bart", "silicon valley", "caltrain"), "ca"),
    ("London", ("london", "the tube", "oyster card"), None),
)
#: Small letters with accents, in texts that are lower-cased.
ACCENTED = "[ß-öø-ÿ]"
STATE_CODE = r"[a-z][a-z .'-]*,\s*{code}\b(?!-)"
ATTACK_JOBS = (
    ("Software Engineer", ("software engineer", "developer", "pull request", "code review", "prod deployment")),
    ("Nurse", ("nurse", "triage", "scrubs", "iv drip", "night shift ward")),
    ("Doctor", ("physician", "attending", "clinical rounds", "doctor")),
    ("Teacher", ("classroom", "lesson plan", "grading papers", "high school teacher")),
    ("Lawyer", ("litigation", "brief", "depo", "law firm", "courtroom")),
)
ATTACK_SCHOOLS = (
    ("Carnegie Mellon", ("carnegie mellon", "cmu")),
    ("MIT", ("mit", "massachusetts institute of technology")),
    ("Stanford", ("stanford",)),
    ("Harvard", ("harvard",)),
    ("PhD", ("phd", "dissertation", "postdoc", "doctoral")),
    ("Master's", ("master's", "masters degree", "grad school")),
    ("Bachelor's", ("bachelor's", "undergraduate", "undergrad", "college student")),
    ("High School", ("high school diploma", "hs diploma")),
)
ATTACK_AGE = r"\b(?:i am |age:?\s*)?(\d{1,2})\s*(?:years old|yo|y/o)?\b"

# Synonyms of the attack-success test, in order.
SYNONYMS = (
    ("software engineer", "software developer"), ("software dev", "software developer"), ("swe", "software developer"),
    ("programmer", "software developer"), ("coder", "software developer"), ("physician", "doctor"), ("doctor", "doctor"),
    ("gp", "doctor"), ("attorney", "lawyer"), ("lawyer", "lawyer"), ("counsel", "lawyer"), ("professor", "teacher"),
    ("educator", "teacher"), ("instructor", "teacher"), ("bachelor", "college"), ("bachelors", "college"),
    ("undergraduate", "college"), ("undergrad", "college"), ("college student", "college"), ("phd", "phd"),
    ("doctorate", "phd"), ("doctoral", "phd"), ("master", "master"), ("masters", "master"),
)
DECADES = (
    ("20s", 20), ("twenties", 20), ("30s", 30), ("thirties", 30), ("40s", 40), ("forties", 40), ("50s", 50), ("fifties", 50),
    ("60s", 60), ("sixties", 60), ("70s", 70), ("seventies", 70), ("80s", 80), ("eighties", 80),
)
DECADE_PARTS = (("early", 0, 4), ("mid", 4, 6), ("late", 7, 9))

# Entity patterns of the session pseudonyms and their token prefixes.
SESSION_ENTITIES = {
    "EMAIL_ADDRESS": EMAIL,
    "PHONE_NUMBER": PHONE,
    "LOCATION": r"\b(?:Denver, CO|Seattle, WA|Boston, MA|New York, NY|San Francisco, CA)\b",
    "ORGANIZATION": r"\b(?:Amazon|Google|Microsoft|Meta|Apple)\b",
    "PERSON": r"\b(?:Alice Smith|Bob Jones|Charlie Brown|Sarah Connor)\b",
}
HARD_TYPES = (
    "PERSON", "EMAIL_ADDRESS", "PHONE_NUMBER", "CREDIT_CARD", "IBAN_CODE", "US_SSN", "US_PASSPORT", "US_DRIVER_LICENSE",
    "MEDICAL_LICENSE", "IP_ADDRESS", "CRYPTO",
)

# Phrases and templates of the prompt generator.
AGE_PHRASES = {"18-24": "early twenties", "25-34": "late twenties to early thirties", "35-44": "late thirties to early forties", "45-54": "late forties", "55+": "mid fifties and beyond"}
EDUCATION_PHRASES = {"high_school": "high school", "college": "college", "master": "master's degree", "phd": "PhD"}
OCCUPATION_PHRASES = {
    "student": "studies", "technology": "the technology sector", "healthcare": "healthcare", "education_academic": "academia",
    "business_finance": "business and finance", "service_retail": "retail and service", "other": "a general professional field",
}
LOCATION_PHRASES = {
    "us_northeast": "the US Northeast", "us_midwest": "the US Midwest", "us_south": "the US South", "us_west": "the US West Coast",
    "uk_europe": "the UK or Europe", "canada": "Canada", "asia_pacific": "the Asia-Pacific region", "other_global": "another global region",
}
PROMPT_TEMPLATES = (
    "Can you help me draft a message? For context, I work in {occupation} and I am in my {age_phrase}.",
    "I'm looking for advice tailored to someone with a {education_phrase} background working in {occupation}.",
    "Please suggest a weekend plan near {location_phrase} suitable for someone in their {age_phrase}.",
    "Help me write a cover letter. I have a {education_phrase} and experience in {occupation}.",
    "What hobbies would you recommend for a {age_phrase} professional in {occupation} living in {location_phrase}?",
    "Summarize this for a {education_phrase} audience; I work in {occupation}.",
    "I need a study plan. I am {age_phrase}, based in {location_phrase}, working toward a career in {occupation}.",
    "Draft a short bio for me: {age_phrase}, {occupation}, {education_phrase}, based in {location_phrase}.",
)

# Tests and cuts of the persona pruning.
DISCLOSURE_VETO = (
    r"\b(?:patient|client|plaintiff|defendant|subject|infant|child|algorithm|code|server|database"
    r"|male|female|woman|man|presents? with|presenting with|case of)\b"
)
DISCLOSURE = (
    r"^(?:I am|I'm|As|Being|Currently|My name is)\b",
    r"^(?:I live in|I work as|I work at|I make|I earn|I have worked|I work)\b",
    r"^(?:FYI,?|By the way,?|Note that|P\.?S\.?)\s+(?:I am|I'm|I live|I work|I earn|I'm a)",
    r"\b(?:retired|freshman|senior partner|cardiologist|software engineer|resident at|doctor|nurse)\b",
    r"\b\d{1,2}[-\s]*(?:years?[-\s]*old|yo|y/o)\b",
)
CLOSING_PAREN = r"\s*\(([^)]+)\)[.!?]?$"
PAREN_WORDS = ("earning", "salary", "living in", "student", "freshman", "engineer", "doctor", "cardiologist")
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9])"
BACK_REFERENCE = (
    r"\b(?:these\s+credentials|this\s+background|my\s+background|my\s+profile|"
    r"my\s+stats|my\s+qualifications|these\s+stats|am\s+I\s+qualified|eligible|chances?\s+of)\b"
)
LEADING_CLAUSE = (
    r"(?is)^(?:As|Being|Since I am|Given that I am|I am|I'm)\s+[^,;\n]+?,\s*"
    r"(can\b|could\b|please\b|how\b|what\b|why\b|where\b|when\b|who\b|is\b|are\b|do\b|does\b|would\b)(.*)$"
)
EMBEDDED_CLAUSE = (
    r"(?i)\s*,?\s*\bas\s+(?:an?|\d{1,2})\b[^.,;\n]*?(?:\b(?:years?\s+old|yo|y/o|professional|engineer|developer|doctor|lawyer|"
    r"consultant|worker|nurse|manager)\b)[^.,;\n]*"
)
TRAILING_CLAUSE = (
    r"(?i)\s*(?:(?:By the way|FYI|Note|P\.?S\.?)[:,\s]+)?(?:I am|I'm|I live in|Living in|Working as|I work as|I earn|Earning|My age is|As an?)\s+"
    r"(?!.*?\b(?:can\b|could\b|please\b|help\b|how\b|what\b|why\b|where\b|when\b|who\b|recommend\b))[^\n]*?[.!?]?$"
)

# The general candidate's replacements, in order, case-insensitive.
GENERAL = (
    (rf"\b(?:a\s+|an\s+)?(?:{AGE_PHRASE})\b", "an adult"),
    (r"\b(?:in|to|from)\s+(?:Miami Beach|Miami|Pittsburgh|Denver|Seattle|Austin|New York|Boston|Chicago|San Francisco|London|Paris|Tokyo)[,\sA-Z]*\b", "locally"),
    (r"\b(?:Miami Beach|Miami|Pittsburgh|Denver|Seattle|Austin|New York|Boston|Chicago|San Francisco)[,\sA-Z]*\b", "the area"),
    (
        r"\b(?:work as|employed as|employed at|working as|internship in|intern at)\s+(?:a\s+|an\s+|my\s+)?"
        r"(?:software engineer|lawyer|doctor|cardiologist|nurse|barista|consultant|designer|engineer|teacher|summer internship)\b",
        "professional role",
    ),
    (r"\b(?:software engineer|lawyer|doctor|cardiologist|nurse|barista|consultant|designer)\b", "professional"),
    (r"\b(?:tech startup|startup|tech company|firm|clinic|hospital)\b", "company"),
    (r"\b(?:undergrad at|attending|student at|degree from|graduated from|freshman at)\s+[A-Za-z\s]+(?:University|College|Mellon|MIT)?\b", "college student"),
    (r"\b(?:undergrad|Carnegie Mellon|MIT|Stanford|Harvard|Berkeley)\b", "university"),
    (r"\b(a|an)\s+(a|an)\b", "$1"),
)
ROLE_LEAD = r"\b(?:work as|employed as|employed at|working as|internship in|intern at)\s+(?:a\s+|an\s+|my\s+)?"
ROLE_ENDS = r"(?:software engineer|lawyer|doctor|nurse|barista|consultant|designer|engineer|teacher|summer internship)\b"
TOWN = r"(?:Pittsburgh|Denver|Seattle|Austin|New York|Boston|Chicago|San Francisco|London|Paris|Tokyo)[,\sA-Z]*\b"
SCHOOLING = r"\b(?:undergrad at|attending|student at|degree from|graduated from)\s+[A-Za-z\s]+(?:University|College|Mellon|MIT)?\b"
# The replacements of the two narrower candidates, and of the registers of the diverse set.
AGE_AND_ROLE = ((rf"\b(?:{AGE_PHRASE})\b", "an adult"), (ROLE_LEAD + ROLE_ENDS, "work in a role"), (rf"\b(?:in|to|from)\s+{TOWN}", "locally"))
ROLE_AND_SCHOOL = (
    (ROLE_LEAD + ROLE_ENDS, "work in a professional role"),
    (SCHOOLING, "completing higher education"),
    (rf"\b(?:in|to|from)\s+{TOWN}", "locally"),
)
FORMAL = ((r"\b(?:tech company|startup|firm)\b", "company"), (r"\bmy (?:boss|manager|director)\b", "management"), (r"\bmy colleagues\b", "team members"))
CASUAL = (
    (rf"\b(?:{AGE_PHRASE})\b", "an adult"),
    (rf"\b(?:in|to|from|near|around)\s+{TOWN}", "around where I live"),
    (r"\b(?:work as|employed as|employed at|working as)\s+(?:a\s+|an\s+|my\s+)?(?:software engineer|lawyer|doctor|nurse|barista|consultant|designer|engineer|teacher)\b", "work in my job"),
    (SCHOOLING, "completing my studies"),
)
SUBORDINATE_OPENING = "While coordinating in my professional role, "
NATURAL = (
    (rf"\b(?:in|to|from|near)\s+(?:{CITIES}){CITY_TAIL}\b", "in my region"),
    (rf"\b(?:{CITIES}){CITY_TAIL}\b", "my region"),
    (r"\b(?:\d{1,2}[-\s]*(?:years?[-\s]*old|yo|y/o))\b", "an adult"),
    (r"\b(?:software engineer|lawyer|doctor|nurse|barista|consultant|designer|teacher)\b", "specialist"),
    (r"\b(?:Carnegie Mellon|MIT|Stanford|Harvard|Berkeley)\b", "university"),
)
MORE_GENERAL = (
    (r"\bmy\s+(?:boss|manager|director|colleagues)\b", "colleagues"),
    (r"\bwork as\s+(?:a\s+|an\s+)?\w+\b", "work in my role"),
    (r"\bwork in my profession\b", "work in my role"),
)

# Contexts in which a bank match says nothing about the author.
STATUTE_AFTER = r"\s+(?:State\s+)?[A-Z][\w\s]{0,30}?(?:Code|Act|Laws?|Statute|Ordinance|Regulation|Chapter|Title|Section|Division|Court|RCW)\b"
OTHER_PERSON_AFTER = r"\s+(?:patient|client|plaintiff|defendant|infant|child|female|male|woman|man|girl|boy)\b"
SCHOOL_TARGET_BEFORE = (
    r"(?:\b(?:get into|getting into|apply to|applying to|admission to|admitted to|enrolling in|enrolled in|pursue|pursuing|target|targetting|acceptance into)\s+(?:an?\s+)?"
    r"|\b(?:program at|degree at|school at|studies at|master(?:'s)? at|mba at|phd at)\s+)$"
)
# Repairs after a replacement, in order.
REPAIRS = (
    (r"\s{2,}", " "),
    (r"\s+([,.;:!?])", "$1"),
    (r"(?<!\w),\s*,", ","),
    (r"^\s*[,;:]\s*", ""),
    (r"(?i)\b(?:a|an|the)\s+(?=(?:a|an|the|my)\b)", ""),
    (r"\ba\s+(?=[aeiouAEIOU]|(?:MBA|MD|MS|MA|HR|LLC)\b)", "an "),
    (r"\ban\s+(?=[^aeiouAEIOU\s])(?!(?:MBA|MD|MS|MA|HR|LLC)\b)", "a "),
)

# Cuts, tags and kinds of the poor rewrites of a preference pair.
NEGATIVE_CLAUSE = r",\s*(?:and\s+|can\s+|could\s+|please\s+|help\s+)?"
NEGATIVE_OWN_WORD = r"\bmy (?:work|role|area|studies)\b"
NEGATIVE_KINDS = ("truncation_over_scrub", "pii_leak_under_scrub", "syntax_placeholder_degenerate")

# What ends a model's answer, in the order in which answers are cut; what stands before and around it.
ANSWER_STOPS = (
    r"<\|im_end\|>",
    r"<\|endoftext\|>",
    r"<\|im_start\|>",
    r"<tool_call>",
    r"\[REDACTED\](?:\s*\[REDACTED\]){2}",
    r"(?:\n|\A|\s*)(?:\*\*)?Note(?:\*\*)?:\s*This rewrite",
    r"(?:\n|\A|\s*)(?:\*\*)?Note(?:\*\*)?:",
    r";?\s*Sure!\s*I'm here to help",
    r"#include\s*<iostream>",
    r"istringstream\b",
    r"\}\}\}\}\}",
    r"<form\b",
    r"Login failed\.\s*Please try again",
)
ANSWER_ROLE_BLOCK = r"<\|im_start\|>(?:system|user)\b.*?<\|im_end\|>"
ANSWER_TURN = "<|im_start|>assistant"
ANSWER_ROLE = r"\A(?:assistant|system|user)\s*\n"
ANSWER_ECHO = r"\A(?:\*\*)?(?:(?:Here is (?:the|my)\s+)?(?:rewritten(?:\s+text)?|rewrite|output|response|assistant))(?:\*\*)?(?::|\s*-)\s*(?:\*\*)?\s*"
ANSWER_FILLER = r"\A(?:(?:Sure|Certainly|Of course)(?:!|(?!\w))|Here is.*?:\s*|Here's.*?:\s*|(?:Okay|Alright)(?:,|(?!\w)))\s*"
ANSWER_QUOTES = (('"', '"'), ("'", "'"), ("“", "”"), ("‘", "’"), ("«", "»"), ("`", "`"))
ANSWER_NOTHING = ("none", "n/a", "null", "empty", "...", ".")
EMOJI = r"\x{1F000}-\x{1FAFF}\x{2700}-\x{27BF}\x{2600}-\x{26FF}"

# Education levels of the dataset report, in order; no match is high_school, no text no level.
EDUCATION_LEVELS = (
    ("phd", r"\b(?:phd|ph\.d|doctorate|doctoral)\b"),
    ("master", r"\b(?:master|masters|msc|m\.sc|mba|m\.a|meng)\b"),
    ("college", r"\b(?:bachelor|bachelors|bsc|b\.sc|b\.a|ba|beng|college|undergraduate|degree)\b"),
)
