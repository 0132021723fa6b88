"""Character classes and regular expressions in Java syntax. U+0958..U+095F are only ever written as escapes."""

C = "\u0915-\u0939"
CP = C + "\u0958-\u095f"
TOKEN = "\u0900-\u0963\u0970-\u097f"
DEVA = "\u0900-\u097f"
MARKS = "\u093c\u0901-\u0903\u093e-\u0943\u0947-\u0949\u094b-\u094d"
DOUBLED = "\u0901-\u0903\u093c\u093e-\u0943\u0947\u0948\u094b-\u094d"
VOWELS = "\u093e-\u0943\u0947\u0948\u094b\u094c"
#: White space as Python understands it, over the whole BMP.
WS = r"[\s\x1c-\x1f\x85\p{Z}]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
HALANT, NUKTA, I_SIGN, ZWJ = "\u094d", "\u093c", "\u093f", "\u200d"
CLUSTER = f"(?:[{C}]{HALANT})*[{C}]"

TOKENS = f"[{TOKEN}]+"
PIECES = f"[{TOKEN}]+|[^{TOKEN}]+"

STRAY_ZWJ = f"{ZWJ}(?=[{MARKS}])|(?<=[{MARKS}]){ZWJ}"
DUP_HALANT = f"{HALANT}{{2,}}"
HALANT_DUP = f"{HALANT}([{CP}])\\1"
REPEATED_CONSONANT = f"([{CP}])\\1"
DUP_MARKS = f"([{DOUBLED}])\\1+"
DUP_MARK_CLUSTER = f"([{VOWELS}][\u0901\u0902])\\1+"
LEADING_I = f"^{I_SIGN}(?=[{DEVA}])"
J_SWAP = f"\u091c({CLUSTER})"
LEADING_YI = f"^\u092f{I_SIGN}"
PRE_CLUSTER_I = f"{I_SIGN}(?=[{CP}]{HALANT})"
PRE_ANUSVARA_I = f"{I_SIGN}(?=[\u0901\u0902][{CP}])"
BROKEN_E = "[\u0947\u0948][\u093e-\u0943\u094b\u094c]"
SPURIOUS_NUKTA = f"[{C}]{HALANT}?{NUKTA}"
NONSTANDARD_NUKTA = f"[\u091a\u091b\u091d-\u0920\u0924-\u0928\u092a\u092c-\u0930\u0932\u0935-\u0939]{HALANT}?{NUKTA}"
SUSPICIOUS_MARKS = f"[{VOWELS}\u0949\u0945][\u0901-\u0903]?[{VOWELS}\u0949\u0945]"

#: What makes a token worth correcting, and what keeps it from a fuzzy guess.
CONSIDER = (LEADING_I, J_SWAP, DUP_HALANT, HALANT_DUP, REPEATED_CONSONANT, DUP_MARK_CLUSTER, NONSTANDARD_NUKTA, DUP_MARKS, SUSPICIOUS_MARKS)
NO_GUESS = (LEADING_I, J_SWAP, BROKEN_E, DUP_HALANT, HALANT_DUP, REPEATED_CONSONANT, DUP_MARK_CLUSTER)
STRUCTURAL = (DUP_HALANT, HALANT_DUP, REPEATED_CONSONANT, DUP_MARK_CLUSTER)
STRAY_I = (LEADING_YI, PRE_CLUSTER_I, PRE_ANUSVARA_I)

AUXILIARIES = ("\u0939\u0948", "\u0939\u0942\u0901", "\u0939\u0948\u0902", "\u0925\u093e", "\u0925\u0940", "\u0925\u0947")
SINGLE_MARKS = "\u093e\u093f\u0940\u0941\u0942\u0947\u0948\u094b\u094c\u0902"
#: Sequences of signs that stand for one sign, in this order.
SIGN_SEQUENCES = (
    ("\u093e\u0902\u0947", "\u094b\u0902"),
    ("\u093e\u0947", "\u094b"),
    ("\u093e\u0948", "\u094c"),
    ("\u093e\u0949", "\u0949"),
    ("\u0947\u093e", "\u093e"),
    ("\u0947\u094b", "\u094b"),
)
#: Fixed strings that the last repair steps rewrite, in this order.
WORD_FIXES = (
    ("\u0907\u090f\u0902", "\u090f\u0902"),
    ("\u0906\u0907\u090f\u0902", "\u0906\u090f\u0902"),
    ("\u094d\u093e", "\u093e"),
    ("\u0905\u094c\u0930", "\u0914\u0930"),
    ("\u0905\u093e\u0930", "\u0906\u0930"),
    ("\u090f\u0915\u093c", "\u090f\u0915"),
)
