"""Differences between clips: constraint buckets, fuzzy text differences, history references, typed items, plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stepwright.functions import arrays as A
from stepwright.functions.text import content_tokens, dedupe, phrases, strip, term_value

#: Word hints of each kind, in order of precedence.
HINTS: tuple[tuple[str, str], ...] = (
    ("mood", "aggressive brooding calm chill dark dramatic emotional happy haunting introspective melancholic nostalgic optimistic playful relaxed romantic sad tense triumphant uplifting"),
    ("texture", "acoustic ambient atmospheric cinematic cold dense distorted electronic gritty layered lush minimal reverb sparse texture warm"),
    ("energy", "driving energetic energy explosive gentle intense powerful punchy quiet soft subtle"),
    ("rhythm", "arpeggio arpeggios beat groove percussion pulse rhythm staccato swing syncopated tempo"),
    ("instrument", "bass brass cello drums flute guitar horn horns organ pad pads piano strings synth synths violin vocal vocals"),
    ("atmosphere", "atmosphere atmospheric dreamy ethereal meditative moody mysterious space spacious"),
)
AXIS_OF_KIND = {"atmosphere": "texture_production", "energy": "energy", "instrument": "instrumentation", "mood": "mood", "rhythm": "rhythm", "speed": "speed", "tag": "genre_style", "texture": "texture_production", "vocal_status": "vocals"}


def buckets(source_tags: Column, target_tags: Column, source_vocals: Column, target_vocals: Column, source_speed: Column, target_speed: Column) -> Column:
    """struct(persistent, added, lost) of sorted distinct terms; vocals and speed count as prefixed terms."""

    def facet(name: str, s: Column, t: Column) -> tuple[Column, Column, Column]:
        s, t = strip(s), strip(t)
        label = lambda c: F.array(F.concat(F.lit(name + ":"), c))
        none = F.array().cast("array<string>")
        same = (s != "") & (s == t)
        return F.when(same, label(t)).otherwise(none), F.when(~same & (t != ""), label(t)).otherwise(none), F.when(~same & (t != "") & (s != ""), label(s)).otherwise(none)

    v, p = facet("vocals", source_vocals, target_vocals), facet("speed", source_speed, target_speed)
    tags = (A.preserved(source_tags, target_tags), A.added(source_tags, target_tags), A.removed(source_tags, target_tags))
    return F.struct(*(F.sort_array(F.array_distinct(F.concat(t, a, b))).alias(n) for n, t, a, b in zip(("persistent", "added", "lost"), tags, v, p, strict=True)))


def fuzzy_difference(source: Column, target: Column, terms: int = 8, most_phrases: int = 6) -> Column:
    """struct of added, removed and shared terms and phrases, in order of appearance, each once, the first few."""
    st, tt, sp, tp = content_tokens(source), content_tokens(target), phrases(source), phrases(target)

    def differ(x: Column) -> Column:
        # Both functions keep the first array's order and each item once.
        out, both = F.array_except, F.array_intersect
        return F.struct(
            dedupe(out(x["tt"], x["st"]), terms).alias("added_terms"), dedupe(out(x["st"], x["tt"]), terms).alias("removed_terms"), dedupe(both(x["tt"], x["st"]), terms).alias("shared_terms"),
            dedupe(out(x["tp"], x["sp"]), most_phrases).alias("added_phrases"), dedupe(out(x["sp"], x["tp"]), most_phrases).alias("removed_phrases"), dedupe(both(x["tp"], x["sp"]), most_phrases).alias("shared_phrases"),
        )

    return A.let(F.struct(st.alias("st"), tt.alias("tt"), sp.alias("sp"), tp.alias("tp")), differ)


def refreshed(delta_source: Column, delta_target: Column, source: Column, target: Column) -> Column:
    """struct(source, target) of lyrics: the manifest's where either is not empty, else those of the delta."""
    some = (strip(source) != "") | (strip(target) != "")
    return F.when(some, F.struct(strip(source).alias("source"), strip(target).alias("target"))).otherwise(F.struct(delta_source.alias("source"), delta_target.alias("target")))


def history_references(steps: DataFrame, k: int = 2) -> DataFrame:
    """chain_id, turn, prior_turn, shared_tags, reintroduced_tags, shared_terms, score, place: the k best earlier targets.

    steps: chain_id, turn, tags, terms (sets). Turn t looks at the turns before t - 1; score is 3 for each tag that
    comes back after having been absent, 2 for each shared tag, 1 for each shared term; nothing shared is no reference.
    """
    w = Window.partitionBy("chain_id").orderBy("turn")
    before = F.collect_list(F.struct("turn", "tags", "terms")).over(w.rowsBetween(Window.unboundedPreceding, -2))
    s = steps.withColumns({"_previous": F.coalesce(F.lag("tags").over(w), F.array().cast("array<string>")), "_before": before})
    e = s.select("chain_id", "turn", "tags", "terms", "_previous", F.explode("_before").alias("b"))
    shared = A.preserved(F.col("tags"), F.col("b.tags"))
    e = e.select("chain_id", "turn", F.col("b.turn").alias("prior_turn"), shared.alias("shared_tags"), F.sort_array(F.array_except(shared, F.col("_previous"))).alias("reintroduced_tags"), A.preserved(F.col("terms"), F.col("b.terms")).alias("shared_terms"))
    e = e.withColumn("score", 3 * F.size("reintroduced_tags") + 2 * F.size("shared_tags") + F.size("shared_terms")).where("score > 0")
    place = F.row_number().over(Window.partitionBy("chain_id", "turn").orderBy(F.col("score").desc(), "prior_turn"))
    return e.withColumn("place", place).where(F.col("place") <= k)


def item_source(term: Column, tags: Column, captions: Column, lyrics: Column) -> Column:
    """Where a term comes from: tag for prefixed facets, else where it is found, in the order tags, captions, lyrics."""
    t = F.lower(strip(term))
    found = lambda a: F.exists(a, lambda x: (x != "") & F.contains(F.lower(x), t))
    facet = t.startswith("vocals:") | t.startswith("speed:")
    return F.when(facet | found(tags), "tag").when(found(captions), "caption").when(found(lyrics), "lyrics").when(F.contains(t, F.lit(" ")), "caption").otherwise("semantic")


#: Each hint word with the place of its first kind.
_HINT_OF = {w: k for k, (_, words) in reversed(list(enumerate(HINTS, 1))) for w in words.split()}


def semantic_items(terms: Column, tags: Column, captions: Column, lyrics: Column) -> Column:
    """An array of struct(text, source, kind), one for each term: its facet prefix decides, else item_source() and the hints of its words.

    The texts to search are joined once by NUL, so that a term costs one search of each; a term with a NUL is in none.
    """
    hints = F.create_map(*(F.lit(x) for kv in _HINT_OF.items() for x in kv))
    kinds = F.array(*(F.lit(k) for k, _ in HINTS))
    line = lambda a: F.lower(F.array_join(F.filter(a, lambda x: x != ""), "\x00"))

    def item(x: Column, where: Column) -> Column:
        t = x["t"]
        found = lambda n: (where[n] != "") & F.contains(where[n], t)
        sought = F.when(found("tags"), "tag").when(found("captions"), "caption").when(found("lyrics"), "lyrics").when(F.contains(t, F.lit(" ")), "caption").otherwise("semantic")
        hint = F.array_min(F.transform(F.split(F.replace(t, F.lit("-"), F.lit(" ")), " "), lambda w: F.try_element_at(hints, w)))
        return A.let(
            F.struct(sought.alias("source"), hint.alias("hint")),
            lambda s: F.struct(
                x["text"].alias("text"), F.when(t.startswith("vocals:") | t.startswith("speed:"), "tag").otherwise(s["source"]).alias("source"),
                F.when(t.startswith("vocals:"), "vocal_status").when(t.startswith("speed:"), "speed").when(s["hint"].isNotNull(), F.try_element_at(kinds, s["hint"])).when(s["source"] == "tag", "tag").otherwise("semantic").alias("kind"),
            ),
        )

    tidy = F.transform(F.transform(terms, strip), lambda x: F.struct(x.alias("text"), F.replace(F.lower(x), F.lit("\x00"), F.lit("\x01\x00\x01")).alias("t")))
    where = F.struct(line(tags).alias("tags"), line(captions).alias("captions"), line(lyrics).alias("lyrics"))
    return A.let(F.struct(where.alias("where"), tidy.alias("terms")), lambda e: F.transform(e["terms"], lambda x: item(x, e["where"])))


def semantic_item(term: Column, tags: Column, captions: Column, lyrics: Column) -> Column:
    """struct(text, source, kind) of a term, as semantic_items() has it."""
    return semantic_items(F.array(term), tags, captions, lyrics)[0]


def typed_texts(items: Column, source: str | None = None) -> Column:
    """Texts of typed items, of one source if given, each once in order."""
    kept = F.filter(items, lambda x: x["source"] == source) if source else items
    return dedupe(F.transform(kept, lambda x: x["text"]))


def axis_of(item: Column) -> Column:
    kinds = F.create_map(*(F.lit(x) for kv in AXIS_OF_KIND.items() for x in kv))
    return F.when(item["source"] == "lyrics", "lyrics_theme").otherwise(F.coalesce(F.try_element_at(kinds, item["kind"]), F.lit("other")))


def plan(new: Column, lost: Column, kept: Column) -> Column:
    """struct(shape, change_axes, preservation_axes, changes, preservations) of typed items."""
    entry = lambda x, way: F.struct(axis_of(x).alias("axis"), x["source"].alias("source"), F.lit(way).alias("direction"), x["text"].alias("evidence"))
    some = lambda a: F.filter(a, lambda x: x["text"] != "")
    changes = F.concat(F.transform(some(new), lambda x: entry(x, "new")), F.transform(some(lost), lambda x: entry(x, "lost")))
    keeps = F.transform(some(kept), lambda x: entry(x, "kept"))
    axes = lambda a: F.array_distinct(F.transform(a, lambda x: x["axis"]))

    def made(e: Column) -> Column:
        c, k = e["changes"], e["preservations"]
        shape = F.when(F.size(c) >= 2, "two_changes").when((F.size(c) > 0) & (F.size(k) > 0), "one_change_one_preservation").otherwise("one_change")
        return F.struct(shape.alias("shape"), axes(c).alias("change_axes"), axes(k).alias("preservation_axes"), c.alias("changes"), k.alias("preservations"))

    return A.let(F.struct(changes.alias("changes"), keeps.alias("preservations")), made)


def evidence_terms(fuzzy: Column, raw: Column, least: int = 4) -> Column:
    """Fuzzy terms and the raw text's tokens of at least `least` characters, each once in order."""
    return dedupe(F.concat(fuzzy, F.filter(content_tokens(raw, least), lambda t: F.length(t) >= least)))


def fallback_delta(recorded: Column, alias: Column, derived: Column) -> Column:
    """The first of three structs that is there."""
    return F.coalesce(recorded, alias, derived)


def precheck(instruction: Column, change_terms: Column, has_metadata: Column, aware: bool, caption_only: Column, typed_terms: Column, raw_terms: Column, least: int = 12) -> Column:
    """Reasons against an instruction, each once, in a fixed order; none if it passes."""
    from stepwright.functions.labels import has_relative_cue, term_hits

    t = strip(instruction)
    low = F.lower(t)
    reasons = [
        F.when((F.length(t) < least) | ~has_relative_cue(t), "format"),
        F.when((F.size(change_terms) > 0) & (term_hits(t, change_terms) == 0), "no_genuine_change"),
        F.when(caption_only & (((F.size(typed_terms) > 0) & (term_hits(t, typed_terms) == 0)) | ((F.size(typed_terms) == 0) & (F.size(raw_terms) > 0) & (term_hits(t, raw_terms) == 0))), "caption_only_ungrounded"),
        F.when(~has_metadata & low.rlike(r"\b(\d{4}|album|singer|band|artist)\b"), "metadata_invention"),
    ]
    if not aware:
        reasons.append(F.when(F.contains(low, F.lit("as before")), "requires_history"))
    return F.array_compact(F.array(*reasons))


__all__ = ["axis_of", "buckets", "evidence_terms", "fallback_delta", "fuzzy_difference", "history_references", "plan", "precheck", "refreshed", "semantic_item", "term_value", "typed_texts"]
