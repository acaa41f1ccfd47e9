"""Character classes with Python's meaning of space, upper-case, digit and word.

Java's ``\\s``, ``\\p{Lu}``, ``\\p{Nd}`` and ``\\w`` differ from ``str.isspace``, ``str.isupper``,
``str.isdigit`` and ``re``'s ``\\w``.  The bodies below close the gap and read the same in Java's
regex engine and in RE2, so a query and its SQL check can share them.
"""

# Code points that count as space, upper case, digit and word character.
WS_BODY = (
    r"\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
UPPER_BODY = (
    r"\p{Lu}\x{2160}-\x{216f}\x{24b6}-\x{24cf}"
    r"\x{1f130}-\x{1f149}\x{1f150}-\x{1f169}\x{1f170}-\x{1f189}"
)
DIGIT_BODY = (
    r"\p{Nd}\x{b2}-\x{b3}\x{b9}\x{1369}-\x{1371}\x{19da}\x{2070}\x{2074}-\x{2079}"
    r"\x{2080}-\x{2089}\x{2460}-\x{2468}\x{2474}-\x{247c}\x{2488}-\x{2490}\x{24ea}"
    r"\x{24f5}-\x{24fd}\x{24ff}\x{2776}-\x{277e}\x{2780}-\x{2788}\x{278a}-\x{2792}"
    r"\x{10a40}-\x{10a43}\x{10e60}-\x{10e68}\x{11052}-\x{1105a}\x{1f100}-\x{1f10a}"
)
WORD_BODY = r"\p{L}\p{N}_"

# Fixed value: the nine characters counted as punctuation.
PUNCTUATION = ".,;!?:'\"-"

WS = f"[{WS_BODY}]"
NOT_WS = f"[^{WS_BODY}]"
UPPER = f"[{UPPER_BODY}]"
DIGIT = f"[{DIGIT_BODY}]"
WORD_TOKEN = f"[{WORD_BODY}]{{2,}}"

# Forms for Java's engine, which evaluates a class left to right.  Leading with the ASCII ranges
# (an intersection for space, unions for the complements) settles the common characters early;
# measured on mixed-language prose this is two to eight times faster than the plain class.
WS_JAVA = rf"[\x00-\x20\x7f-\x{{10ffff}}&&[{WS_BODY}]]"
NOT_UPPER_JAVA = rf"[\x00-\x40\x5b-\x7f[^{UPPER_BODY}]]"
NOT_DIGIT_JAVA = rf"[\x00-\x2f\x3a-\x7f[^{DIGIT_BODY}]]"
NOT_PUNCTUATION = "[^" + PUNCTUATION.replace("-", r"\-") + "]"
