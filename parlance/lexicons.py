"""Word lists, patterns and weights. Operators take them as parameters; these are the defaults."""

# ---- Fixed values: lists whose members decide results. ----

STOP_WORDS = """
the a an is are was were be been being have has had do does did will would could should may might can shall to of in
for on with at by from as into through during before after above below between out off over under again further then
once here there when where why how all each every both few more most other some such no nor not only own same so than
too very just because but and or if while about this that these those it its i me my we our you your he him his she
her they them their what which who whom up also like know think say said
है हैं था थी थे को का की के में से पर ने और या भी तो ही जो कि यह वह इस उस एक नहीं कर हो
""".split()

PHRASE_STOP_WORDS = """
the a an is are was were be been to of in for on with at by from and or but not this that it we you he she they i me
my so if as
""".split()

POSITIVE = """
great excellent amazing wonderful fantastic good best love awesome brilliant perfect beautiful impressive powerful
remarkable outstanding incredible success benefit advantage improve achieve win gain grow happy exciting innovative
elegant efficient robust
""".split()

NEGATIVE = """
bad terrible awful horrible worst hate poor failure problem issue bug error crash broken difficult complex confusing
frustrating annoying slow expensive vulnerable dangerous risk threat loss decline decrease unfortunately sadly worse
""".split()

EMOTIONS = {
    "joy": "happy joy wonderful beautiful love grateful blessed bliss आनन्द सुख प्रेम कृपा".split(),
    "devotion": "devotion surrender divine sacred prayer worship भक्ति प्रार्थना श्रद्धा पूजा ईश्वर".split(),
    "reverence": "respect honor guru teacher wisdom noble गुरु श्रद्धा सम्मान ज्ञान विद्या".split(),
    "peace": "peace calm serene tranquil meditat silence शान्ति ध्यान मौन समाधि".split(),
    "sadness": "sad sorrow grief suffer pain loss दुःख शोक पीड़ा कष्ट".split(),
    "anger": "anger fury rage destroy fight war क्रोध युद्ध संहार".split(),
    "fear": "fear afraid terror danger death dark भय मृत्यु अन्धकार".split(),
    "wonder": "amazing miracle mysterious infinite cosmic अद्भुत विस्मय अनन्त ब्रह्माण्ड".split(),
}
BRIGHT = ["joy", "devotion", "reverence", "peace", "wonder"]
DARK = ["sadness", "anger", "fear"]

PATTERNS = {
    "emphasis": [
        r"\b(?:importantly|crucially|key\s+point|essential|critical|fundamental)\b",
        r"\b(?:remember|note\s+that|pay\s+attention|keep\s+in\s+mind)\b",
        r"\b(?:the\s+most\s+important|the\s+key\s+takeaway|the\s+main\s+point)\b",
        r"\b(?:above\s+all|first\s+and\s+foremost|most\s+notably)\b",
    ],
    "action_item": [
        r"\b(?:you\s+should|you\s+need\s+to|make\s+sure|don'?t\s+forget)\b",
        r"\b(?:take\s+action|next\s+step|todo|to-do|action\s+item)\b",
        r"\b(?:go\s+ahead\s+and|try\s+to|start\s+by|begin\s+with)\b",
        r"\b(?:implement|deploy|configure|set\s+up|install)\b",
        r"\b(?:always\s+(?:make\s+sure|ensure|check|verify))\b",
    ],
    "question": [
        r"\?\s*$",  # what stands before the sign plays no part
        r"\b(?:what\s+if|how\s+do|why\s+does|when\s+should|where\s+can)\b",
        r"\b(?:have\s+you\s+ever|did\s+you\s+know|can\s+you\s+imagine)\b",
    ],
    "definition": [
        r"\b(?:is\s+defined\s+as|means\s+that|refers\s+to|is\s+known\s+as)\b",
        r"\b(?:in\s+other\s+words|that\s+is\s+to\s+say|simply\s+put)\b",
        r"\b(?:the\s+definition\s+of|what\s+we\s+mean\s+by)\b",
    ],
    "statistic": [
        r"\b\d+(?:\.\d+)?%",
        r"\b(?:according\s+to|research\s+shows|studies\s+show|data\s+suggests)\b",
        r"\b(?:statistically|on\s+average|the\s+majority|most\s+of)\b",
        r"\$[\d,]+(?:\.\d+)?(?:\s*(?:billion|million|thousand|k|m|b))?\b",
    ],
    "conclusion": [
        r"\b(?:in\s+conclusion|to\s+summarize|to\s+sum\s+up|in\s+summary)\b",
        r"\b(?:finally|lastly|to\s+wrap\s+up|the\s+bottom\s+line)\b",
        r"\b(?:so\s+in\s+short|all\s+in\s+all|overall)\b",
    ],
    "transition": [
        r"\b(?:now\s+let'?s\s+(?:talk|move|look|discuss|turn))\b",
        r"\b(?:moving\s+on\s+to|next\s+up|speaking\s+of)\b",
        r"\b(?:on\s+another\s+note|shifting\s+gears|let'?s\s+switch)\b",
    ],
}

# ---- Fixed values: patterns and weights of insights, actions and quotes. ----

TYPE_WEIGHTS = {"key_point": 0.7, "action_item": 0.6, "statistic": 0.6, "definition": 0.5, "conclusion": 0.7, "emphasis": 0.6, "question": 0.4, "quote": 0.5, "transition": 0.2}
IMPERATIVE = r"^(?:Make\s+sure|Ensure|Always|Never|Don't\s+forget|Remember\s+to)\b"
PROPER = r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"
POINTING = r"\b(?:this|that|these|those|it)\s+(?:is|was|are|were)\b"
SIMILE = r"\b(?:like\s+a|as\s+if|just\s+as)\b"
PARALLEL = r"(\w+)\s+.*\1"
STRONG_WORDS = "never always every must truth believe power change future".split()
TAGS = {
    "infrastructure": r"\b(?:kubernetes|docker|cloud|server|deploy)\b",
    "security": r"\b(?:security|auth|encrypt|vulnerability|CVE)\b",
    "performance": r"\b(?:performance|latency|throughput|cache|optimize)\b",
}
ACRONYMS = r"\b(?:API|SDK|AI|ML|UI|UX|DevOps|CI/CD|REST|GraphQL|SQL|NoSQL)\b"

# ---- Fixed values: names, words and types of entities. ----

SCRIPTURES = [
    r"\b(Bhagavad\s+Gita|Gita)\b",
    r"\b(Upanishad|Vedanta|Yoga\s+Sutra|Brahma\s+Sutra)\b",
    r"\b(Rig\s+Veda|Sama\s+Veda|Yajur\s+Veda|Atharva\s+Veda)\b",
    r"\b(Ramayana|Mahabharata|Purana)\b",
    r"\b(Patanjali|Shankaracharya|Vivekananda)\b",
]
COMMON_FIRST_WORDS = "The This That There These Those What When Where Why How Very Also Just Even Still".split()
NER_TYPES = {"PERSON": "person", "ORG": "concept", "GPE": "place", "LOC": "place", "EVENT": "event", "WORK_OF_ART": "text", "NORP": "concept"}

# ---- Fixed values: emotions that a model may name, by sign. ----

GLAD, SORRY = ["joy", "surprise", "love"], ["anger", "sadness", "fear", "disgust"]

# ---- Fixed values: separators of chunks, best first. ----

SEPARATORS = ["\n\n", "\n", "।", ".", "!", "?", ";", ",", " ", ""]

# ---- Fixed values: requests an hour by tier, and paths that need none. ----

EXEMPT = ["/", "/health", "/docs", "/redoc", "/openapi.json", "/config"]
TIER_LIMITS = {"anonymous": 3, "alpha": 10, "pro": 100}
