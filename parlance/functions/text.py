"""Text normalizers, token tests and clock strings, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Filled pauses that the headline word error rate leaves out.
FILLED_PAUSES = ["um", "uh", "umm", "uhh", "mm", "mmm", "hmm", "hm", "mhm", "mmhmm", "uhhuh", "er", "erm", "ah", "eh", "huh"]
# Fillers counted as disfluencies.
FILLERS = ["um", "uh", "mm", "hmm", "mhm", "mmhmm", "uhhuh", "er", "ah", "eh", "huh", "hm"]
# The pattern of a filler token.
FILLER_PATTERN = r"^(u+h+|u+m+|e+r+m?|h+m+|o+h+|a+h+|m{2,}|uh-huh|mm-hm|mhm|huh|hmm?)$"
# Triggers of the three cue families.
CUES = {
    "negation": [
        "no", "not", "never", "none", "nothing", "nowhere", "neither", "without", "cannot", "can't", "don't", "doesn't", "didn't", "isn't",
        "aren't", "wasn't", "weren't", "won't", "wouldn't", "shouldn't", "couldn't", "hasn't", "haven't", "hadn't",
    ],
    "modality": [
        "maybe", "probably", "possibly", "definitely", "certainly", "unsure", "sure", "i think", "i guess", "i feel like", "kind of",
        "sort of", "almost", "likely", "unlikely", "seems", "seems like",
    ],
    "temporal": [
        "today", "yesterday", "tomorrow", "tonight", "now", "recently", "lately", "currently", "earlier", "later", "last week",
        "last month", "last year", "past week", "past month", "past year", "for months", "for years", "in weeks", "in months",
    ],
}
# Words that answer or acknowledge, and words that mark discourse.
BACKCHANNELS = ["yeah", "yes", "yep", "okay", "ok", "right", "sure", "alright", "true", "exactly", "gotcha", "wow", "oh", "no", "nope", "cool", "good", "great"]
DISCOURSE = ["like", "so", "just", "well", "actually", "basically", "literally", "anyway", "anyways", "know", "mean", "guess", "think", "kinda", "sorta"]
# Numbers and ordinals as words.
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen",
    "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty",
    "ninety", "hundred", "thousand", "first", "second", "third", "fourth", "fifth", "sixth", "seventh", "eighth", "ninth", "tenth",
]
# Beginnings of questions.
QUESTION_OPENERS = ["how", "what", "when", "where", "why", "who", "which", "do you", "does", "did you", "have you", "has", "are you", "is there", "can you", "could you", "would you", "in the past"]
# Months.
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
# Parts of file names that don't identify a session.
NOISE_TOKENS = ["interviewaudiotranscript", "interviewaudio", "audiotranscript"]
NOISE_PATTERN = r"(?i)(_interviewAudioTranscript|_final_humanReadable|_final|_REDACTED|_UNREDACTED)"


def words_of(text: Column) -> Column:
    """Words between white space; none for null or blank text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def one_of(word: Column, values: list[str]) -> Column:
    return word.isin(values)


def unwrap_brackets(text: Column) -> Column:
    """``[word?]`` becomes ``word``; white space collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"\[([^\]]*?)\??\]", "$1"), r"\s+", " "))


def _plain(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.regexp_replace(text, r"\[[^\]]*\]", " ")), r"[^a-z0-9'\s]", " ")


def headline(text: Column) -> Column:
    """For the headline error rate: bracketed events and filled pauses left out."""
    return F.array_join(F.filter(words_of(_plain(text)), lambda w: ~w.isin(FILLED_PAUSES)), " ")


def headline_with_pauses(text: Column) -> Column:
    return F.array_join(words_of(_plain(text)), " ")


def alnum_only(text: Column) -> Column:
    """Brackets deleted without a gap, then everything but letters, digits and space."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\[.*?\]", ""), r"[^a-zA-Z0-9\s]", ""), r"\s+", " ")))


def loose_tokens(text: Column, normalize: bool = False) -> Column:
    """Tokens after bracketed and braced groups, whose trailing characters stay."""
    text = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\](\S*)", "$1"), r"\{[^\}]*\}(\S*)", "$1")
    return words_of(F.lower(F.regexp_replace(text, r"[.,?!\-—;:\"'()]", "")) if normalize else text)


def content_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(F.regexp_replace(F.lower(text), r"\[[^\]]*\]", " "), r"[{}]", " "), F.lit("[a-z0-9']+"), F.lit(0))


def token(word: Column) -> Column:
    return F.regexp_replace(F.lower(word), r"[^a-z0-9']", "")


def session_stem(name: Column) -> Column:
    """File stem without the parts that don't identify a session."""
    return F.lower(F.array_join(F.filter(F.split(name, "_"), lambda t: ~F.lower(t).isin(NOISE_TOKENS)), "_"))


def session_name(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(name, r"\.[A-Za-z0-9]+$", ""), NOISE_PATTERN, "")


def is_filler(word: Column) -> Column:
    return F.lower(word).rlike(FILLER_PATTERN)


def is_event(word: Column) -> Column:
    return F.trim(word).rlike(r"^\[.+\]$")


def is_question(text: Column) -> Column:
    """Ends with a question mark or begins with an opener (a prefix, whatever follows it)."""
    plain = F.lower(F.trim(text))
    return plain.endswith("?") | plain.rlike("^(" + "|".join(QUESTION_OPENERS) + ")")


def cues(text: Column) -> Column:
    """``family:trigger`` of every trigger that a normalized text holds as whole words."""
    padded = F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" "))
    every = F.array(*[F.when(padded.contains(f" {t} "), F.lit(f"{family}:{t}")) for family, ts in CUES.items() for t in ts])
    return F.filter(every, lambda x: x.isNotNull())


def cue_score(reference: Column, hypothesis: Column) -> Column:
    """Twice the shared cues over all; 1 if neither has any, 0 if only the hypothesis has."""
    a, b = cues(reference), cues(hypothesis)
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when(F.size(a) == 0, 0.0).otherwise(2 * both / (F.size(a) + F.size(b)))


def near_miss(a: Column, b: Column) -> Column:
    """The same word written differently rather than another word."""
    digits = lambda x: x.rlike("^[0-9]+$")
    shorter, longer = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    inflected = (F.length(shorter) >= 4) & longer.startswith(shorter) & (F.length(longer) - F.length(shorter) <= 3)
    most = F.when(F.length(shorter) <= 4, 1).otherwise(2)
    return (a.isin(NUMBER_WORDS) & b.isin(NUMBER_WORDS)) | digits(a) | digits(b) | inflected | (F.levenshtein(a, b) <= most)


def leak_kind(text: Column) -> Column:
    """What a readable identifier looks like.  Months count wherever the letters stand, also inside a word."""
    body = F.lower(F.trim(text))
    n = F.size(words_of(body))
    return (
        F.when(body.rlike(r"^[0-9\s\-/.]+$"), "number")
        .when(body.rlike("(" + "|".join(MONTHS) + ")") | body.rlike(r"\b[0-9]{1,2}(st|nd|rd|th)\b"), "month or date")
        .when(n == 1, "single word").when(n <= 3, "two or three words").otherwise("longer phrase")
    )


def lexical_type(text: Column) -> Column:
    """``date`` if any token is a month or ordinal or all are digits; else null."""
    tokens = F.filter(F.transform(words_of(text), token), lambda t: t != "")
    ordinal = r"^[0-9]{1,2}(st|nd|rd|th)$|^(first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth|eleventh|twelfth)$"
    dated = F.exists(tokens, lambda t: t.isin(MONTHS) | t.rlike(ordinal)) | F.forall(tokens, lambda t: t.rlike("^[0-9]+$"))
    return F.when((F.size(tokens) > 0) & dated, F.lit("date"))


def parse_clock(text: Column) -> Column:
    """Seconds of ``[[H:]M:]S[.f]``; null where it is none."""
    return F.when(text.rlike(r"^[0-9]+(:[0-9]+)*(\.[0-9]+)?$"), F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, x: a * 60 + x.try_cast("double")))


def tenths_clock(seconds: Column) -> Column:
    """``hh:mm:ss.s``; times before zero count as zero."""
    tenths = F.bround(F.greatest(seconds.cast("double"), F.lit(0.0)) * 10, 0).cast("long")
    return F.format_string("%02d:%02d:%02d.%d", F.floor(tenths / 36000).cast("long"), F.pmod(F.floor(tenths / 600), F.lit(60)).cast("long"), F.pmod(F.floor(tenths / 10), F.lit(60)).cast("long"), F.pmod(tenths, F.lit(10)))


def format_clock(seconds: Column, comma: bool = False) -> Column:
    """``HH:MM:SS.mmm``, rounded half to even."""
    ms = F.rint(seconds * 1000).cast("long")
    return F.format_string("%02d:%02d:%02d" + ("," if comma else ".") + "%03d", F.floor(ms / 3600000), F.floor(ms / 60000) % 60, F.floor(ms / 1000) % 60, ms % 1000)


def preview(text: Column, n: int = 40) -> Column:
    words = words_of(text)
    return F.when(F.size(words) > n, F.concat(F.array_join(F.slice(words, 1, n), " "), F.format_string(" [+%d more words]", F.size(words) - n))).otherwise(F.array_join(words, " "))


def length_bucket(value: Column, edges: list[float]) -> Column:
    """``<e`` for the first edge above the value, ``e+`` beyond the last."""
    out = F.lit(f"{edges[-1]:g}s+")
    for e in reversed(edges):
        out = F.when(value < e, F.lit(f"<{e:g}s")).otherwise(out)
    return F.when(value.isNotNull(), out)


def whole_word_replace(text: Column, word: str, by: str) -> Column:
    import re

    return F.regexp_replace(text, rf"(?<!\w){re.escape(word)}(?!\w)", by.replace("\\", r"\\").replace("$", r"\$"))


def slug(title: Column) -> Column:
    """A title as a name of a file."""
    return F.replace(F.replace(F.lower(title), F.lit(" "), F.lit("-")), F.lit("/"), F.lit("-"))


def escape(text: Column) -> Column:
    """Text that stands in markup."""
    out = text
    for mark, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(mark), F.lit(name))
    return out


def interval_iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two intervals; 0 where they don't overlap."""
    both = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    return F.when(both <= 0, 0.0).otherwise(both / ((a_end - a_start) + (b_end - b_start) - both))
