"""Captions and prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import MAX_WORDS, TYPE_ORDER

#: Every Unicode blank, since the regular expressions' own class knows only ASCII ones.
BLANK = r"[\t\n\x0B\f\r\x1C-\x1F \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"

# The prompts' wording.
AUDIT_PROMPT = (
    "Determine whether this image-text pair is pristine or manipulated. "
    "Return exactly one JSON object with keys verdict, types, image_bbox, and text_positions. "
    "verdict must be pristine or manipulated. types must be selected from "
    "[face_swap, face_attribute, text_swap, text_attribute]. "
    "image_bbox must be null or [x1,y1,x2,y2] normalized to 0-1000. "
    "text_positions must contain zero-based word indices in the normalized News text. "
    "Do not include markdown or extra explanation."
)
VERDICT_PROMPT = "Decide whether the image-text pair is pristine or manipulated. Answer with exactly one word: pristine or manipulated."
TYPE_DESCRIPTIONS = {
    "face_swap": "a face identity swap",
    "face_attribute": "a manipulated facial attribute",
    "text_swap": "a swapped text entity or phrase",
    "text_attribute": "a manipulated textual attribute",
}


def strip_blanks(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


#: Characters that a caption has as spaces, and then those that it loses.
SPACED, DROPPED = "-/", """,.'!?"()*#:;~"""


def normalize_caption(text: Column, max_words: int = MAX_WORDS) -> Column:
    """Lower case without punctuation, dashes and slashes as spaces, runs of blanks as one, at most max_words words.

    Once runs are one space, a cut before a space has no blank at its end, so only what is left needs the end stripped.
    """
    plain = F.replace(F.translate(F.lower(text), SPACED + DROPPED, " " * len(SPACED)), F.lit("<person>"), F.lit("person"))
    plain = F.regexp_replace(F.regexp_replace(plain, f"{BLANK}{{2,}}", " "), f"^{BLANK}", "")
    return F.regexp_replace(F.substring_index(plain, " ", max_words), f"{BLANK}+$", "")


def count_words(text: Column) -> Column:
    """Runs without a blank; printable ASCII has one kind of blank, which needs no regular expression."""
    plain = F.size(F.array_remove(F.split(text, " ", -1), ""))
    return F.when(text.rlike("[^ -~]"), F.size(F.filter(F.split(text, f"{BLANK}+", -1), lambda w: w != ""))).otherwise(plain)


def audit_prompt(caption: Column) -> Column:
    return F.concat(F.lit("<image>\nNews text: "), caption, F.lit("\n" + AUDIT_PROMPT))


def verdict_prompt(caption: Column) -> Column:
    return F.concat(F.lit("News text: "), caption, F.lit("\n" + VERDICT_PROMPT))


def type_prompts(caption: Column) -> Column:
    """array<struct<type, prompt>>: one question for each type."""
    ask = lambda t: F.concat(F.lit("News text: "), caption, F.lit(f"\nDoes this image-text pair contain {TYPE_DESCRIPTIONS[t]}? Answer with exactly one word: yes or no."))
    return F.array(*[F.struct(F.lit(t).alias("type"), ask(t).alias("prompt")) for t in TYPE_ORDER])


def strip_image_token(prompt: Column) -> Column:
    """Without the first token and its newline, then without the first token left, then without blanks in front."""
    once = F.regexp_replace(prompt, r"(?s)^(.*?)<image>\n", "$1")
    return F.regexp_replace(F.regexp_replace(once, r"(?s)^(.*?)<image>", "$1"), f"^{BLANK}+", "")


def comma_list(text: Column) -> Column:
    """Trimmed parts that aren't blank."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), strip_blanks), lambda x: x != "")
