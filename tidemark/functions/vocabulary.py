"""Cue vocabulary of annotators' texts: movements and readings, and the feature each movement should show in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stems(*begins: str) -> str:
    """Any word that begins with one of these."""
    return r"\b(?:" + "|".join(begins) + r")\w*"


def near(parts: str, motions: str) -> str:
    """A part of the body and what it does, either first, with at most two words between."""
    part, motion, gap = rf"(?:{parts})\w*", rf"(?:{motions})\w*", r"(?:\s+\w+){0,2}\s+"
    return rf"\b(?:{part}{gap}{motion}|{motion}{gap}{part})"


# The names of the cues and of the features each is expected to move (none: not measured). The patterns say
# what a cue means, in the order they are tried.
MOVEMENTS: dict[str, tuple[list[str], list[str]]] = {
    "brow_raise": ([near("brow|eyebrow|eye brow", "rais|lift|arch|elevat|rise")], ["brow_raise"]),
    "brow_furrow": ([stems("frown", "furrow", "scowl"), near("brow|eyebrow|forehead", "knit|lower|wrinkl|drawn|contract")], ["brow_furrow"]),
    "head_shake": ([stems("headshake"), near("head", "shak|waggl|swivel|sway")], ["head_shake"]),
    "head_nod": ([stems("nod"), near("head|chin", "bob|dip|bounc")], ["head_nod"]),
    "head_tilt": ([stems("tilt"), near("head|chin", "cock|inclin|slant|sideways|lean")], []),
    "mouth_shape": ([stems("mouth", "lip", "jaw", "teeth", "tongue", "pout", "purs")], ["mouth_morpheme"]),
    "smile": ([stems("smil", "grin", "beam", "smirk")], ["mouth_positive"]),
    "eye_widen": ([near("eye", "wid|bulg|pop|stretch|enlarg")], []),
    "blink_close": ([stems("blink", "wink"), near("eye|eyelid|lid", "clos|shut|squeez|narrow|squint")], []),
    "gaze_shift": ([stems("gaz", "glanc", "staring"), near("eye|look|looks|looking", "away|aside|elsewhere|contact|direct|dart|follow")], []),
    "sign_size": ([near("sign|movement|gesture|motion|space", "large|big|small|tiny|tight|compact|spacious|broad|sized")], ["amplitude"]),
    "speed_fast": ([stems("fast", "quick", "rapid", "hurr", "swift", "brisk", "speed")], ["speed"]),
    "speed_slow": ([stems("slow", "deliberat", "unhurr", "leisur", "drawn out")], ["speed"]),
    "repetition": ([stems("repeat", "repetit", "redupl"), r"\b(?:once more|over and over|again|twice|thrice)\b"], ["repetition"]),
    "emphasis": ([stems("emphas", "emphat", "exagger", "accentuat", "forc", "stress")], ["jerk", "volume", "amplitude"]),
    "fingerspelling": ([r"\b(?:finger|hand)\s?spel\w*", near("spell", "letter|name|word|hand")], []),
    "pause_hesitation": ([stems("paus", "hesita", "halt", "falter", "linger")], ["pause_ratio", "pause_mean"]),
    "body_posture": ([stems("postur", "torso", "trunk", "shoulder", "slouch", "upright"), near("body|chest|back", "lean|bend|bent|straight|turn|stiff")], []),
}
#: What says how a face is read, not what it does: words of telling, and names of feelings
READINGS: list[str] = [
    stems("convey", "suggest", "impl", "express", "communicat", "reveal"), stems("seem", "appear", "impression", "sense of", "as if"), stems("feel", "emotion", "mood", "tone", "attitude"),
    stems("surpris", "astonish", "shock", "amaz"), stems("worr", "anxi", "nerv", "fear", "afraid", "scar"), stems("sad", "grie", "disappoint", "regret"), stems("happ", "joy", "delight", "cheer", "pleas"),
    stems("ang", "annoy", "irritat", "frustrat", "furious"), stems("disgust", "contempt", "dislik"), stems("curio", "interest", "wonder"), stems("confus", "puzzl", "unsure", "doubt"),
    stems("excit", "enthusias", "eager"), stems("bored", "boring", "indiffer"), stems("neutral", "calm", "relax"), stems("positive", "negative"),
]


def in_words(pattern: str) -> str:
    """A pattern with its word limits spelled out for letters of all scripts; what it matches is group 1. Regular
    expression engines differ in what they take for a word."""
    body, word = pattern.removeprefix(r"\b").removesuffix(r"\b"), r"[\p{L}\p{N}_]"
    end = r"(?:$|[^\p{L}\p{N}_])" if pattern.endswith(r"\b") else ""
    return r"(?i)(?:^|[^\p{L}\p{N}_])(" + body.replace(r"\w", word) + ")" + end


def span(text: Column, patterns: list[str]) -> Column:
    """What the first pattern that occurs in a text has matched first; NULL if none occurs."""
    return F.coalesce(*[F.nullif(F.regexp_extract(text, in_words(p), 1), F.lit("")) for p in patterns])


def movements(text: Column) -> Column:
    """Map of the movements a text names to what names them."""
    found = F.array(*[F.struct(F.lit(cue).alias("cue"), span(text, patterns).alias("span")) for cue, (patterns, _) in MOVEMENTS.items()])
    return F.map_from_entries(F.filter(found, lambda s: s["span"].isNotNull()))


def readings(text: Column) -> Column:
    """What each reading's pattern has matched in a text, in the order of the patterns."""
    return F.filter(F.array(*[F.nullif(F.regexp_extract(text, in_words(p), 1), F.lit("")) for p in READINGS]), lambda x: x.isNotNull())


def span_sql(patterns: list[str], text: str = "text") -> str:
    return "coalesce(" + ", ".join(f"nullif(regexp_extract({text}, '{in_words(p)}', 1), '')" for p in patterns) + ", NULL)"
