"""Word lists, patterns, limits and lookup tables.

They decide results, so they are kept as plain text in one place.
"""

# --- line grammar of a printed statute (fixed values) ------------------------
PREAMBLE_OPENING = "WE, THE PEOPLE OF INDIA"
PREAMBLE_CLOSING = "THISCONSTITUTION."
PAGE_NUMBER = r"^\d{1,3}$"
ITEM_HEADING = r"^(\d{1,4}[A-Z]{0,2})\.\s+(.+)$"
BARE_NUMBER = r"^(\d{1,3}[A-Z]{0,2})\.$"
CLAUSE_START = r"^\((\d{1,2}[A-Z]?)\)\s*(.*)$"
EXPLANATION = r"(?i)^Explanation\s*(?:([IVX]+))?\.\s*(.*)$"
ILLUSTRATION = r"(?i)^Illustration\b[.:]?\s*(.*)$"
MARKER = r"^(\d{1,2})\*?\[\s*"
FOOTNOTE_NUMBER = r"^\d{1,2}\.\s+"
FOOTNOTE_START = (
    r"(?i)^\d{1,2}\.\s+(Ins\.|Subs\.|Add|Omit|Substitut|Amend|Re-?numbered|Renumber|Repealed|The words|The entry"
    r"|The bracket|Note|Ed\.|Also see|Published|Certain|Art\.?|Cl\.|Cls\.|Clause|Sub-cl|See|Section|Sch\.?|Para"
    r"|Entry|Original|Part\s|In exercise|W\.e\.f)"
)
FOOTNOTE_SIGNAL = (
    r"(?i)\b(ibid\.|w\.e\.f|vide|notification|ins\.|subs\.|omit|renumber|added|repealed|proviso|explanation"
    r"|sub-clause|word|words|act,|s\.\s|sch\.)|\b(19|20)\d\d"
)
PART_HEADING = r"^PART([IVXLCDM]+[A-Z]?)$"
PART_ROMAN = r"^(M{0,3}(?:CM|CD|D?C{0,3})(?:XC|XL|L?X{0,3})(?:IX|IV|V?I{0,3}))([A-B]?)$"
CHAPTER_HEADING = r"^CHAPTER([IVX]+)\."
APPENDIX_HEADING = r"^APPENDIXI"
TITLE_DASHES = "\u2011\u2012\u2013\u2014\u2015\u23AF"
CITATION = r"(?i)Constitution\s*\(([^)]+?)\s+Amendment\)\s+Act"
CITATION_YEAR = r"(?i)Constitution\s*\(([^)]+?)\s+Amendment\)\s*Act,?\s*(\d{4})"
SEQUENCE_JUMP = 40
YEAR = r"\b(19\d\d|20\d\d)\b"

# Headings whose printed form is missing from the text layer (fixed values).
SCHEDULE_ANCHORS = [("[Articles 59(3)", 2, "Provisions as to the President and the Governors of States")]
PART_NAME_ANCHORS = [
    ("THEUNIONTERRITORIES", "8", "THE UNION TERRITORIES"),
    ("FUNDAMENTALDUTIES", "4A", "FUNDAMENTAL DUTIES"),
    ("TRIBUNALS", "14A", "TRIBUNALS"),
]
LANDMARK_ITEMS = ["1", "14", "19", "21", "32", "51A", "368", "395"]
MIN_PARTS, MIN_SCHEDULES, SYNTHETIC_MIN_PARTS = 20, 10, 15

# --- closed code sets and schema patterns (fixed values) ---------------------
ITEM_STATUSES = ["in-force", "amended", "omitted", "repealed"]
BILL_STATUSES = ["pending", "passed-one-house", "rejected", "lapsed"]
CLAUSE_KINDS = ["clause", "explanation", "illustration", "proviso"]
HOUSES = ["lok-sabha", "rajya-sabha", "both"]
THEMES = ["rights", "federal", "emergency", "social", "general"]
REF_TYPES = ["article", "part", "amendment", "page"]
ITEM_NUMBER = r"^\d{1,3}[A-Z]{0,2}$"
PART_REFERENCE = r"^\d{1,2}[A-Z]?$"
PART_NUMBER = r"^\d{1,2}[A-B]?$"
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
SLUG = r"^[a-z0-9-]+$"

# --- prose rules (fixed values) ----------------------------------------------
BANNED_PHRASES = [
    "delve",
    "moreover",
    "furthermore",
    "it is important to note",
    "in conclusion",
    "in today's",
    "fast-paced",
    "plays a crucial role",
    "it is worth noting",
    "a testament to",
]
BANNED_PHRASES_HI = [
    "यह ध्यान देने योग्य है",
    "यह ध्यान रखने योग्य है",
    "यह नोट करने योग्य है",
    "कुल मिलाकर",
    "संक्षेप में",
    "दूसरे शब्दों में",
    "महत्वपूर्ण बात यह है",
    "आइए",
    "आइये",
    "वास्तव में",
    "निष्कर्षतः",
    "सरल शब्दों में",
]
STOP_WORDS = (
    "a an the is are was were be being how what which who when where why of in to for on at by with from and or "
    "not it its as do does did can"
).split()

# --- number words (fixed values) ---------------------------------------------
ORDINAL_UNITS = [
    "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
    "eleventh", "twelfth", "thirteenth", "fourteenth", "fifteenth", "sixteenth", "seventeenth",
    "eighteenth", "nineteenth",
]
CARDINAL_UNITS = [
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten",
    "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def _ordinal(n: int) -> str:
    """Ordinal word of 1 to 99."""
    if n < 20:
        return ORDINAL_UNITS[n - 1]
    ten, unit = TENS[n // 10 - 2], n % 10
    return f"{ten}-{ORDINAL_UNITS[unit - 1]}" if unit else f"{ten[:-1]}ieth"


#: Words that number a schedule's heading, by rule.
SCHEDULE_WORDS = [_ordinal(n).upper() for n in range(1, 100)]

# --- Devanagari (fixed values) -----------------------------------------------
VOWEL_SIGNS = "\u093E\u093F\u0940\u0941\u0942\u0943\u0944\u0945\u0946\u0947\u0948\u0949\u094A\u094B\u094C"
VIRAMA = "\u094D"
NUKTA = "\u093C"
SUFFIX_CONSONANTS = "कखगघङचछजझञटठडढणतथदधनपफबभमय"
SUFFIX_CONFUSIONS = [("झ", "ज"), ("ज", "ञ"), ("ञ", "ज")]
FOOTNOTE_SIGNALS_HI = [
    "अधिनियम",
    "प्रतिस्थापित",
    "अंतःस्थापित",
    "के स्थान पर",
    "स्थान पर",
    "अधिसूचना",
    "राजपत्र",
    "लोप किया",
]
# Raw code points kept by the skeleton of a word.
SKELETON_CLASS = r"\u0905-\u0939\u093C-\u094D\u0950-\u0963\u0966-\u096F"

# --- limits (fixed values) ---------------------------------------------------
CHUNK_MIN_WORDS, CHUNK_MAX_WORDS = 120, 180
SIMILARITY_THRESHOLD = 0.8
VECTOR_CUTOFF, VECTOR_LIMIT, KEYWORD_LIMIT = 0.4, 24, 12
ARTIFACT_BUDGET = 3 * 1024 * 1024
PAGE_BUDGET = 60 * 1024
MAX_ITEM_NUMBER = 395
MONTHS = (
    "January|February|March|April|May|June|July|August|September|October|November|December"
)
