"""Fixed values the results depend on.

FIXED VALUES - these must stay exactly as written for results to match the
reference behaviour; they are public word lists and rules, not tuning knobs.
"""

# FIXED VALUES: English stop words (the public nltk English list, current
# version with 198 entries), alphabetical order as published.
ENGLISH_STOP_WORDS = (
    "a about above after again against ain all am an and any are aren aren't as at "
    "be because been before being below between both but by "
    "can couldn couldn't d did didn didn't do does doesn doesn't doing don don't down during "
    "each few for from further had hadn hadn't has hasn hasn't have haven haven't having "
    "he he'd he'll her here hers herself he's him himself his how "
    "i i'd if i'll i'm in into is isn isn't it it'd it'll it's its itself i've just "
    "ll m ma me mightn mightn't more most mustn mustn't my myself needn needn't no nor not now "
    "o of off on once only or other our ours ourselves out over own re s same "
    "shan shan't she she'd she'll she's should shouldn shouldn't should've so some such "
    "t than that that'll the their theirs them themselves then there these they they'd they'll "
    "they're they've this those through to too under until up ve very "
    "was wasn wasn't we we'd we'll we're were weren weren't we've what when where which while "
    "who whom why will with won won't wouldn wouldn't y you you'd you'll your you're yours "
    "yourself yourselves you've"
).split()

# FIXED VALUES: contraction splits of the Treebank word tokenizer that can still
# occur after cleaning (all other rules of that tokenizer act on punctuation,
# which cleaning has already replaced by spaces).
CONTRACTION_SPLITS = (
    ("cannot", ("can", "not")),
    ("gimme", ("gim", "me")),
    ("gonna", ("gon", "na")),
    ("gotta", ("got", "ta")),
    ("lemme", ("lem", "me")),
    ("wanna", ("wan", "na")),
)

# FIXED VALUES: noun suffix detachment rules of WordNet's morphological
# analyser, in its rule order (suffix, replacement).
NOUN_SUFFIX_RULES = (
    ("s", ""),
    ("ses", "s"),
    ("ves", "f"),
    ("xes", "x"),
    ("zes", "z"),
    ("ches", "ch"),
    ("shes", "sh"),
    ("men", "man"),
    ("ies", "y"),
)

# FIXED VALUES: the characters that Python's str.split and re take as white
# space, as the inside of a character class that Java and RE2 both read.
WHITESPACE_CLASS = (r"\x{09}-\x{0D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
                    r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
WHITESPACE_RE = f"[{WHITESPACE_CLASS}]+"
# every decimal digit, and every char that is neither a word char (letters,
# numbers of any kind, underscore; no marks, no other connectors) nor white space
CLEAN_RE = r"\p{Nd}|[^\p{L}\p{N}_" + f"{WHITESPACE_CLASS}]"

# a run of what CLEAN_RE matches and of white space: all but letters, numbers
# other than decimal digits, and underscore
GAP_RE = r"[^\p{L}\p{Nl}\p{No}_]+"

# FIXED VALUES: bounds of the index size search: bits per table are the powers
# of two from 2^6, tables the powers from 2^1 to 2^(trial - 1).
FIRST_TRIAL = 6
MAX_TRIALS = 20
