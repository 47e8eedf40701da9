"""Column functions that classify and rewrite caption text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cadenza.functions.text import similarity

# Words spoken as digits, short words that stand alone, power words, negations and calls to action.
SPOKEN = {"10": "ten", "1": "one", "2": "two", "3": "three", "4": "four", "5": "five", "6": "six", "7": "seven", "8": "eight", "9": "nine", "0": "zero"}
LONE_LETTERS = ["a", "i", "o"]
POWER = ["never", "always", "best", "worst", "secret", "free", "instantly", "amazing", "shocking"]
NEGATIONS = ["no", "not", "never", "don't", "won't", "can't", "nothing"]
CTA = ["follow", "subscribe", "comment", "share", "save", "link in bio", "dm", "join"]
RAGE = "(?i)you won.t believe|destroyed|humiliated|this is disgusting|everyone is wrong"
FILLED = "(?i)^(um+|uh+|erm+|hmm+)[.,!?]*$"


def displayable(word: Column, confidence: Column | None = None, least: float = 0.15) -> Column:
    """Not blank, not punctuation alone, no speech marker and not doubtful."""
    fine = (F.trim(word) != "") & word.rlike("[\\p{L}\\p{N}]") & ~word.rlike(r"^\s*(\[.*\]|<.*>)\s*$")
    return fine if confidence is None else fine & (F.coalesce(confidence, F.lit(1.0)) >= least)


def heard_artifact(word: Column) -> Column:
    """Single letters other than a, i and o."""
    w = F.lower(word)
    return (F.length(w) == 1) & w.rlike("[a-z]") & ~w.isin(LONE_LETTERS)


def sync_token(plain: Column) -> Column:
    """Whether a plain token takes part in sync: longer than one, and digits at most three long."""
    return (F.length(plain) > 1) & ~plain.rlike("^[0-9]{4,}$")


def risky_token(plain: Column) -> Column:
    """Tokens that recognition often confuses: two letters or fewer, or any digit."""
    return (F.length(plain) <= 2) | plain.rlike("[0-9]")


def emphasis(word: Column) -> Column:
    """number, negation, power or punctuation, in this order; else null."""
    w = F.regexp_replace(F.lower(word), "[^a-z0-9'%$]", "")
    return F.when(w.rlike(r"^[$]?[0-9][0-9]*[%xk]?$"), "number").when(w.isin(NEGATIONS), "negation").when(w.isin(POWER), "power").when(word.rlike("[!?]$"), "punctuation")


def call_to_action(text: Column) -> Column:
    """Any phrase anywhere in the text, inside longer words too."""
    low = F.lower(text)
    hit = F.lit(False)
    for phrase in CTA:
        hit = hit | low.contains(phrase)
    return hit


def rage_bait(text: Column) -> Column:
    return text.rlike(RAGE)


def char_shares(text: Column) -> tuple[Column, Column]:
    """Shares of letters and of symbols among the characters that are not blank."""
    dense = F.regexp_replace(text, r"\s", "")
    n = F.greatest(F.length(dense), F.lit(1))
    return F.length(F.regexp_replace(dense, "[^A-Za-z]", "")) / n, F.length(F.regexp_replace(dense, "[A-Za-z0-9]", "")) / n


def keep_caption(text: Column, confidence: Column) -> Column:
    """Caption candidates: confident, mostly letters, few symbols."""
    letters, symbols = char_shares(text)
    return (confidence >= 0.3) & (letters >= 0.5) & (symbols <= 0.35) & (F.length(F.trim(text)) >= 2)


def phonetic(plain: Column) -> Column:
    """A plain word with its digits as spoken, ten before one; larger numbers come digit by digit."""
    for digits, name in SPOKEN.items():
        plain = F.replace(plain, F.lit(digits), F.lit(name))
    return plain


def spoken_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of two plain words as written, or as spoken where that is greater and the first is under 0.8."""
    written = similarity(a, b)
    return F.when(written >= 0.8, written).otherwise(F.greatest(written, similarity(phonetic(a), phonetic(b))))


def sanitized(text: Column) -> Column:
    """Speakable text: no code fences, links, list bullets, emphasis marks, hash signs or emoji; single blanks."""
    steps = [(r"(?s)```.*?```", " "), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"https?://\S+", " "), (r"(?m)^\s*[-*+]\s+", ""), (r"[*_`~]+", ""), (r"#(\w+)", "$1"),
             (r"[\x{1F300}-\x{1FAFF}\x{2600}-\x{27BF}]", ""), (r"\s+", " ")]
    out = text
    for pattern, to in steps:
        out = F.regexp_replace(out, pattern, to)
    return F.trim(out)


def notation(text: Column) -> Column:
    """Arrows, superscripts after ^ and subscripts after _ as single characters (one digit each)."""
    out = F.replace(F.replace(text, F.lit("->"), F.lit("→")), F.lit("<-"), F.lit("←"))
    for digit, (up, down) in enumerate(zip("⁰¹²³⁴⁵⁶⁷⁸⁹", "₀₁₂₃₄₅₆₇₈₉")):
        out = F.replace(F.replace(out, F.lit(f"^{digit}"), F.lit(up)), F.lit(f"_{digit}"), F.lit(down))
    return out


def ass_escape(text: Column) -> Column:
    """Backslashes, braces and line breaks escaped for styled subtitles."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), r"([{}])", r"\\$1"), "\r?\n", r"\\N")


def llm_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """Price of a call from prices for a million tokens."""
    return (tokens_in * price_in + tokens_out * price_out) / 1_000_000


def backoff_ms(attempt: Column, base: int, cap: int) -> Column:
    """base * 2**attempt, at most cap."""
    return F.least(F.lit(float(base)) * F.pow(F.lit(2.0), attempt), F.lit(float(cap)))


def frame_to_ms(frame: Column, fps: float) -> Column:
    return F.floor(frame * 1000 / F.lit(fps) + 0.5)


def ms_to_frame(ms: Column, fps: float) -> Column:
    return F.floor(ms * F.lit(fps) / 1000 + 0.5)
