"""Word lists and patterns that several packs share."""

import unicodedata

# Tables of the style guides, as they must be for equal results.
SLANG_LEGAL = {"sorta": "sort of", "kinda": "kind of", "wanna": "want to", "gonna": "going to", "gotta": "got to", "coulda": "could have", "shoulda": "should have", "woulda": "would have", "cuz": "because", "ya": "you", "yep": "yes (or yeah)", "yup": "yes (or yeah)"}
SLANG_ENGLISH = {"gonna": "going to", "wanna": "want to", "gotta": "got to", "gotcha": "got you", "kinda": "kind of", "sorta": "sort of", "betcha": "bet you", "dunno": "don't know", "lemme": "let me", "gimme": "give me", "cuz": "because", "cause": "because", "outta": "out of", "hafta": "have to", "coulda": "could have", "shoulda": "should have", "woulda": "would have", "ya": "you"}
YES_FORMS = ("yeah", "yep", "yup", "yap")
SPELLING_LEGAL = ((r"\bO[Kk]\b", False, "okay"), (r"'kay\b", True, "okay"), (r"\balright\b", True, "all right"), (r"\balot\b", True, "a lot"), (r"\betc\b\.?", False, "et cetera"), (r"\bU\.S\.A\.?", False, "USA"), (r"\bU\.S\.(?!A)", False, "US"), (r"\be-mail\b", True, "email"), (r"\bhealth care\b", True, "healthcare"))
CONTRACTIONS_LEGAL = {"could've": "could have", "should've": "should have", "would've": "would have"}
TITLES = "doctor|officer|detective|sergeant|lieutenant|captain|judge|justice|investigator|attorney|professor|nurse|deputy|marshal|colonel|major|general|admiral|reverend|senator|governor|mayor|president|director|chief|counselor|agent"
MONTHS = "January|February|March|April|May|June|July|August|September|October|November|December"
NOT_NAMES = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December", "I")
OWNED = "own|fault|turn|name|job|house|home|car|money|kids?|child(?:ren)?|family|wife|husband|parents?|cabin|responsibility|problem|point|choice|decision|opinion|order|seat|side|hands?|head"
NUMBER_WORDS = "zero|one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred|thousand|million|billion"
LEGAL_TERMS = {
    "habeus corpus": "habeas corpus", "habeas corpis": "habeas corpus", "habeous corpus": "habeas corpus", "voire dire": "voir dire", "vore dire": "voir dire", "vore deer": "voir dire", "war dire": "voir dire",
    "amicus curie": "amicus curiae", "amicus curaie": "amicus curiae", "amicus curii": "amicus curiae", "res ipsa loquitor": "res ipsa loquitur", "res ipsa loquito": "res ipsa loquitur", "res judicada": "res judicata", "race judicata": "res judicata",
    "stare decises": "stare decisis", "starry decisis": "stare decisis", "stare decisus": "stare decisis", "prima facia": "prima facie", "prima fascia": "prima facie", "prema facie": "prima facie",
    "noll prosequi": "nolle prosequi", "nolo prosequi": "nolle prosequi", "nole prosequi": "nolle prosequi", "writ of mandamous": "writ of mandamus", "mandamous": "mandamus", "in limit": "in limine", "in lemine": "in limine", "in liminy": "in limine",
    "per curium": "per curiam", "ex party": "ex parte", "ex partay": "ex parte", "de fato": "de facto", "de juray": "de jure", "duces tecem": "duces tecum", "duces tecom": "duces tecum", "corpus delecti": "corpus delicti", "caveat emptore": "caveat emptor",
    "guardian ad litum": "guardian ad litem", "ad litum": "ad litem", "nunc pro tunk": "nunc pro tunc", "certorari": "certiorari", "certiorary": "certiorari", "subpena": "subpoena", "subpeona": "subpoena", "supena": "subpoena", "subpena duces tecum": "subpoena duces tecum",
    "defendent": "defendant", "defendents": "defendants", "plaintif": "plaintiff", "plaintifs": "plaintiffs", "plantiff": "plaintiff", "plantif": "plaintiff", "affidavid": "affidavit", "affadavit": "affidavit", "affidavate": "affidavit",
    "deposistion": "deposition", "deposicion": "deposition", "deposistions": "depositions", "perjery": "perjury", "purjury": "perjury", "indictement": "indictment", "indightment": "indictment", "indicment": "indictment",
    "prosecuter": "prosecutor", "prosecuters": "prosecutors", "prosicutor": "prosecutor", "testomony": "testimony", "testiphony": "testimony", "testemony": "testimony", "arrainment": "arraignment", "araignment": "arraignment", "malfeasence": "malfeasance", "misfeasence": "misfeasance",
    "jurispudence": "jurisprudence", "jurisprudance": "jurisprudence", "tortuous interference": "tortious interference", "statue of limitations": "statute of limitations", "statue of limitation": "statute of limitations", "et all": "et al.", "et cetra": "et cetera", "et setera": "et cetera", "writ of certorari": "writ of certiorari",
}
GERMAN_OLD = {
    "daß": "dass", "muß": "muss", "mußt": "musst", "mußte": "musste", "müßte": "müsste", "läßt": "lässt", "läßst": "lässt", "gewiß": "gewiss", "schluß": "schluss", "fluß": "fluss", "kuß": "kuss", "nuß": "nuss", "paßt": "passt", "faßt": "fasst", "vergißt": "vergisst",
    "naß": "nass", "streß": "stress", "bißchen": "bisschen", "häßlich": "hässlich", "roß": "ross", "riß": "riss", "biß": "biss", "wißt": "wisst", "küßt": "küsst", "haß": "hass", "paß": "pass", "genuß": "genuss", "schloß": "schloss", "faß": "fass", "gefaßt": "gefasst", "beschloß": "beschloss", "mißt": "misst", "iß": "iss",
}
APOSTROPHES = {
    "dont": "don't", "doesnt": "doesn't", "didnt": "didn't", "isnt": "isn't", "arent": "aren't", "wasnt": "wasn't", "werent": "weren't", "havent": "haven't", "hasnt": "hasn't", "hadnt": "hadn't", "wouldnt": "wouldn't", "couldnt": "couldn't", "shouldnt": "shouldn't", "mustnt": "mustn't", "aint": "ain't",
    "youre": "you're", "theyre": "they're", "ive": "I've", "youve": "you've", "weve": "we've", "theyve": "they've", "thats": "that's", "whats": "what's", "wheres": "where's", "hows": "how's", "theres": "there's", "heres": "here's", "hes": "he's", "shes": "she's",
}
CASUAL_KANA = ("えーと", "えーっと", "えっと", "ええと", "ええっと", "えー", "あのー", "そのー", "うーん", "んーと")
VOCALISATIONS = {"ふーん": "[scoffs]", "ふん": "[scoffs]", "フン": "[scoffs]", "フーン": "[scoffs]", "しーっ": "[shushing]", "シーッ": "[shushing]", "しっ": "[shushing]", "シッ": "[shushing]", "はぁ": "[sighs]", "はあ": "[sighs]", "ハァ": "[sighs]", "ふぅ": "[sighs]", "あはは": "[laughs]", "あははは": "[laughs]", "ははは": "[laughs]", "ハハハ": "[laughs]", "ふふ": "[chuckles]", "えへへ": "[chuckles]", "くすくす": "[chuckles]"}
DO_NOT_USE = {
    "U": "units", "u": "units", "IU": "international units", "QD": "daily", "Q.D.": "daily", "qd": "daily", "QOD": "every other day", "Q.O.D.": "every other day", "qod": "every other day", "MS": "morphine sulfate OR magnesium sulfate", "MSO4": "morphine sulfate", "MgSO4": "magnesium sulfate", "cc": "mL", "ug": "mcg", "µg": "mcg",
    "SC": "subcutaneous", "SQ": "subcutaneous", "D/C": "discharge OR discontinue", "HS": "at bedtime", "TIW": "3 times a week", "AD": "right ear", "AS": "left ear", "AU": "both ears", "OD": "right eye", "OS": "left eye", "OU": "both eyes", "QHS": "nightly at bedtime", "QN": "nightly", "BT": "bedtime", "SS": "sliding scale", "UD": "as directed", "IN": "intranasal", "IT": "intrathecal", "OJ": "orange juice",
    "HCTZ": "hydrochlorothiazide", "MTX": "methotrexate", "AZT": "zidovudine", "CPZ": "Compazine (prochlorperazine)", "HCT": "hydrocortisone", "TAC": "triamcinolone", "T3": "Tylenol with codeine No. 3", "ZnSO4": "zinc sulfate", "PER OS": "by mouth / orally",
}


def any_of(words) -> str:
    """A group of alternatives, in the order given."""
    return "(" + "|".join(words) + ")"


def longest_first(words) -> str:
    return any_of(sorted(words, key=len, reverse=True))

# Rule: letters that decompose into one ASCII letter and marks, and that letter.
_FOLDS = {c: b for c in map(chr, range(0x80, 0x1F00)) if len(b := unicodedata.normalize("NFKD", c).encode("ascii", "ignore").decode()) == 1 and b.isalpha()}
ACCENTED, PLAIN = "".join(_FOLDS), "".join(_FOLDS.values())
