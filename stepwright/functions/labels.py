"""Keys, labels, bands and paths as Column expressions."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from stepwright.functions.arrays import let
from stepwright.functions.text import phrase, strip, text, word_count

#: Coarse genres in order of precedence, with key words that are looked for inside tags.
GENRES: tuple[tuple[str, str], ...] = (
    ("Classical", "piano solo|chamber|opera|baroque|symphony|orchestra|classical"),
    ("Jazz", "bossa|bebop|swing|jazz"),
    ("Blues", "blues"),
    ("Metal", "doom|thrash|metal"),
    ("Punk", "hardcore|punk"),
    ("Hip-hop", "boom bap|trap|rap|hip-hop|hip hop"),
    ("Reggae", "dancehall|dub|ska|reggae"),
    ("Electronic", "chillwave|breakbeat|downtempo|idm|synth|electro|dnb|drum and bass|edm|trance|house|techno"),
    ("Folk", "americana|acoustic|singer-songwriter|folk"),
    ("Country", "bluegrass|country"),
    ("Latin", "cumbia|reggaeton|flamenco|tango|salsa|latin"),
    ("Funk", "funk"),
    ("Soul/R&B", "gospel|motown|rnb|r&b|soul"),
    ("Ambient", "meditation|new age|drone|ambient"),
    ("World", "ethnic|indian|african|celtic|world"),
    ("Pop", "pop"),
    ("Rock", "garage|psychedelic|grunge|alternative|indie|rock"),
    ("Experimental", "noise|avant-garde|experimental"),
)
RELATIVE_CUES = ("again", "bring back", "but", "instead", "keep", "less", "like", "more", "same", "still", "without")
POLITE = r"(?i)\b(please|could\s+you|can\s+you|i['’]d\s+like|i\s+would\s+like|i\s+want)\b"
MOST_WORDS = dict(short=7, medium=12, long=18)
AXES = tuple("energy genre_style instrumentation mood other rhythm speed texture_production theme_or_language vocal_style_or_gender".split())
SUSPICIOUS = ("thank you", "you", "bye")
SUSPICIOUS_ENDS = ("you",)


def time_key(c: Column) -> Column:
    """Seconds with up to three decimals, without zeros at the end."""
    return F.regexp_replace(F.format_string("%.3f", c.cast("double")), r"\.?0+$", "")


def clip_key(track: Column, start: Column, end: Column, ordinal: Column) -> Column:
    return F.concat_ws("::", track.cast("string"), F.concat_ws("-", time_key(start), time_key(end)), ordinal.cast("string"))


def file_stem(c: Column) -> Column:
    """A safe file name: odd characters become _, at most 80 characters, then __ and 12 digits of the SHA-1."""
    safe = F.regexp_replace(F.regexp_replace(text(c), r"[^-._A-Za-z0-9]+", "_"), r"^[._]+|[._]+$", "")
    return F.concat(F.left(safe, F.lit(80)), F.lit("__"), F.substring(F.sha1(text(c)), 1, 12))


def audio_path(track: Column, mode: str, url: Column | None = None, template: str = "{track_id}.mp3") -> Column:
    """url: the url itself; template: {track_id} filled in; shard: a folder of the id's last two characters first."""
    if mode == "url":
        return text(url)
    if mode == "template":
        return F.replace(F.lit(template), F.lit("{track_id}"), text(track))
    return F.concat(F.lpad(F.right(text(track), F.lit(2)), 2, "0"), F.lit("/"), text(track), F.lit(".mp3"))


def duration(start: Column, end: Column) -> Column:
    return F.when(end > start, end - start)


def seconds(ms: Column) -> Column:
    return F.round(ms.try_cast("double") / 1000, 3)


def tempo_label(bpm: Column) -> Column:
    """slow below 90, fast above 140, medium between; empty without a number."""
    x = bpm.try_cast("double")
    return F.when(x.isNull(), "").when(x < 90, "slow").when(x > 140, "fast").otherwise("medium")


def vocal_label(tags: Column, has_lyrics: Column) -> Column:
    return F.when(F.exists(tags, lambda t: F.contains(F.lower(t), F.lit("instrumental"))), "instrumental").when(has_lyrics, "vocal").otherwise("")


def genre(tags: Column) -> Column:
    """First genre, in order of precedence, of which a key word is inside some tag; else Other."""
    line = F.lower(F.concat_ws("|", tags))

    def first(x: Column) -> Column:
        out = None
        for name, words in GENRES:
            hit = reduce(or_, (F.contains(x, F.lit(w)) for w in words.split("|")))
            out = F.when(hit, name) if out is None else out.when(hit, name)
        return out.otherwise("Other")

    return let(line, first)


def band(c: Column, *steps: tuple[float, str], last: str, inclusive: bool = True) -> Column:
    """The label of the first step that c does not exceed (or, if not inclusive, is below); else last."""
    out = None
    for limit, label in steps:
        hit = c <= limit if inclusive else c < limit
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(last)


def hardness(delta: Column) -> Column:
    return band(delta, (1, "easy"), (3, "medium"), last="hard")


def score_band(score: Column) -> Column:
    return band(score, (0.75, "low"), (0.85, "mid"), last="high", inclusive=False)


def turn_band(turn: Column) -> Column:
    return band(turn, (1, "early"), (3, "middle"), last="late")


def variant_band(n: Column) -> Column:
    return F.when(n <= 1, "single").when(n < 5, "partial").otherwise("full5")


def axis_count_band(n: Column) -> Column:
    return F.when(n <= 0, "none").when(n == 1, "single_axis").otherwise("multi_axis")


def clip01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def usage_label(n: Column, most: Column) -> Column:
    """How common a count is against the largest count."""
    r = n / F.greatest(most, F.lit(1))
    return F.when(n <= 0, "rare").when(r < 0.12, "rare").when(r < 0.35, "uncommon").when(r < 0.75, "common").otherwise("very common")


def normalise_axes(a: Column) -> Column:
    """Axes in the menu's spelling; others become `other`; each once."""
    menu = F.array(*map(F.lit, AXES))
    one = F.transform(a, lambda x: F.regexp_replace(F.lower(strip(x)), "[- ]", "_"))
    return F.array_distinct(F.transform(one, lambda x: F.when(F.array_contains(menu, x), x).otherwise("other")))


def style_error(instruction: Column, verbosity: Column) -> Column:
    """non_imperative_request_frame, too_wordy_<n>_words, or null."""
    n = F.regexp_count(text(instruction), F.lit("[0-9A-Za-z][-0-9A-Za-z_'’]*"))
    most = F.element_at(F.create_map(*(F.lit(x) for kv in MOST_WORDS.items() for x in kv)), F.lower(strip(verbosity)))
    return F.when(text(instruction).rlike(POLITE), "non_imperative_request_frame").when(n > most, F.concat(F.lit("too_wordy_"), n.cast("string"), F.lit("_words")))


def has_relative_cue(c: Column) -> Column:
    return F.lower(text(c)).rlike("|".join(RELATIVE_CUES))


def term_hits(c: Column, terms: Column) -> Column:
    """How many non-empty terms are inside the lower-case text."""
    low = F.lower(text(c))
    return F.size(F.filter(terms, lambda t: (t != "") & F.contains(low, t)))


def hallucination(c: Column, most_words: int = 2) -> Column:
    """Why a transcript is suspicious: exact_phrase, short_suffix, or null."""
    p = phrase(c)
    words = F.filter(F.split(p, " "), lambda x: x != "")
    last = F.try_element_at(words, F.lit(-1))
    return F.when(p.isin(*SUSPICIOUS), "exact_phrase").when((F.size(words) > 0) & (F.size(words) <= most_words) & last.isin(*SUSPICIOUS_ENDS), "short_suffix")


def coerce_label(c: Column, options: list[str]) -> Column:
    """The option that equals the answer, exactly, then without regard to case, then by one being the other's start."""
    t = strip(c)
    low = F.lower(t)
    exact = [F.when(t == o, F.lit(o)) for o in options]
    folded = [F.when(low == o.lower(), F.lit(o)) for o in options]
    prefix = [F.when((low != "") & (F.lit(o.lower()).startswith(low) | low.startswith(o.lower())), F.lit(o)) for o in options]
    return F.coalesce(*exact, *folded, *prefix)


def label_score(c: Column, scale: dict[str, int]) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for kv in scale.items() for x in kv)), c)


def digest(*parts: Column) -> Column:
    """SHA-1 of the parts joined by colons."""
    return F.sha1(F.concat_ws(":", *(text(p) for p in parts)))


def abbreviated(n: Column) -> Column:
    """n as 1.2k or 3.4M: ties go to the even digit, as format_number() has it (format_string() rounds them up)."""
    short = lambda x: F.replace(F.format_number(x, 1), F.lit(","), F.lit(""))
    return F.when(n >= 1_000_000, F.concat(short(n / 1e6), F.lit("M"))).when(n >= 1000, F.concat(short(n / 1e3), F.lit("k"))).otherwise(n.cast("string"))


def nice(c: Column) -> Column:
    """snake_case as a capitalised label."""
    t = strip(F.replace(text(c), F.lit("_"), F.lit(" ")))
    return F.concat(F.upper(F.left(t, F.lit(1))), F.lower(F.substring(t, F.lit(2), F.lit(1 << 20))))


def words(c: Column) -> Column:
    return word_count(c)
