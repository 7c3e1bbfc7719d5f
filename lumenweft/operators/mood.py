"""Mood vectors: parsing texts, ranking a catalog, line-ups, explanations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenweft import fixed
from lumenweft.functions import text as T
from lumenweft.functions import vectors as V

NEUTRAL = 0.5


def vector_literal(values: dict[str, float], default: float = NEUTRAL) -> Column:
    return F.array(*(F.lit(float(values.get(axis, default))) for axis in fixed.AXES))


def parse_mood(text: Column, lexicon: dict[str, dict[str, float]] | None = None) -> Column:
    """The mood vector of a text: neutral plus the deltas of its mood words, each axis clamped once.

    Phrases (longest first) are sought in tokens followed by neighbouring pairs and taken out where found, applied
    once; single words apply as often as they stand in the untouched tokens, those of a phrase too. Row-local.
    """
    lexicon = fixed.LEXICON if lexicon is None else lexicon
    phrases = sorted((k for k in lexicon if " " in k or "-" in k), key=len, reverse=True)
    single = {k: v for k, v in lexicon.items() if " " not in k and "-" not in k}
    zero = F.array(*(F.lit(0.0) for _ in fixed.AXES))
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)

    def of(tokens: Column) -> Column:
        total = zero
        if single:
            table = F.create_map(*(x for k, v in single.items() for x in (F.lit(k), vector_literal(v, 0.0))))
            hits = F.filter(tokens, lambda t: t.isin(*single))
            total = F.aggregate(hits, zero, lambda a, t: add(a, F.element_at(table, t)))
        hay = F.array_join(F.concat(tokens, T.bigrams(tokens)), " ")
        for phrase in phrases:
            needle = F.lit(phrase.replace("-", " "))
            total = F.when(F.contains(hay, needle), add(total, vector_literal(lexicon[phrase], 0.0))).otherwise(total)
            hay = F.replace(hay, needle, F.lit(" "))
        return F.transform(total, lambda d: V.clamp(F.lit(NEUTRAL) + d))

    return F.get(F.transform(F.array(T.mood_tokens(text)), of), 0)


def blend(base: Column, slot: dict[str, float], weight: float = 0.7) -> Column:
    """The mood drawn towards a slot's targets, other axes towards neutral."""
    return F.zip_with(base, vector_literal(slot), lambda b, s: V.clamp(b * (1 - weight) + s * weight))


def festival_target(bias: dict[str, float], mood: dict[str, float] | None = None) -> dict[str, float]:
    target = {axis: NEUTRAL for axis in fixed.AXES} | bias
    for axis, value in (mood or {}).items():
        target[axis] = 0.6 * target[axis] + 0.4 * value
    return target


def theme_overlap(a: Column, b: Column) -> Column:
    """Shared lower-cased themes over the geometric mean of both counts; 0 if there are none."""
    low = lambda x: F.array_distinct(F.transform(F.coalesce(x, F.array().cast("array<string>")), lambda t: F.lower(t)))
    return F.when((F.size(low(a)) == 0) | (F.size(low(b)) == 0), 0.0).otherwise(F.size(F.array_intersect(low(a), low(b))) / F.sqrt(F.size(low(a)) * F.size(low(b))))


def scored(pool: DataFrame, target: Column, types: list[str] | None = None, exclude: list | None = None, themes: Column | None = None) -> DataFrame:
    """``pool`` (id, type, mood, themes) with ``score``; filters come before scoring, empty ones filter nothing."""
    if exclude:
        pool = pool.where(~F.col("id").isin(*exclude))
    if types:
        pool = pool.where(F.col("type").isin(*types))
    score = V.cosine(target, F.col("mood"))
    return pool.withColumn("score", score if themes is None else score + 0.15 * theme_overlap(themes, F.col("themes")))


def rank(pool: DataFrame, target: Column, k: int = 5, types: list[str] | None = None, exclude: list | None = None, themes: Column | None = None) -> DataFrame:
    """The k best of ``pool``, ties by id."""
    return scored(pool, target, types, exclude, themes).orderBy(F.desc("score"), "id").limit(k)


def top_per_type(table: DataFrame, limits: list[tuple[str, int]], keys: list[str] | None = None) -> DataFrame:
    """Rows within their type's limit by score, ties by id, as ``rn``."""
    limit = F.create_map(*(x for t, n in limits for x in (F.lit(t), F.lit(n))))
    order = Window.partitionBy(*(keys or []), "type").orderBy(F.desc("score"), "id")
    most = max(n for _, n in limits)
    ranked = table.where(F.col("type").isin(*(t for t, _ in limits))).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= most)
    return ranked.where(F.col("rn") <= F.element_at(limit, F.col("type")))


def unlock_related(pool: DataFrame, seed_id: object, per_type: int = 2) -> DataFrame:
    """For a finished item, the best of every other type by mood and themes; nothing for an unknown id."""
    seed = pool.where(F.col("id") == F.lit(seed_id)).orderBy("id").limit(1).collect()
    if not seed:
        return pool.where("false").select("id", "type", F.lit(0.0).alias("score"), F.lit(0).alias("rn"), F.array().cast("array<string>").alias("shared_themes"))
    seed = seed[0]
    themes = F.array(*(F.lit(t) for t in seed.themes or [])).cast("array<string>")
    target = F.array(*(F.lit(float(x)) for x in seed.mood))
    others = [(t, per_type) for t in fixed.TYPES if t != seed.type]
    best = top_per_type(scored(pool, target, themes=themes), others)
    return best.select("id", "type", "score", "rn", F.array_intersect(F.array_distinct(themes), F.col("themes")).alias("shared_themes")).orderBy(F.desc(F.round("score", 3)), "type", "rn")


def festival_lineup(pool: DataFrame, mood: dict[str, float] | None = None, festivals: list | None = None) -> DataFrame:
    """(festival, tagline, type, rn, id, score) for every festival: two movies, a book, a game, a podcast."""
    named = festivals or fixed.FESTIVALS
    table = F.array(*(F.struct(F.lit(name).alias("festival"), F.lit(tag).alias("tagline"), vector_literal(festival_target(bias, mood)).alias("target")) for name, tag, bias in named))
    each = pool.withColumn("f", F.explode(table)).select("id", "type", "mood", "themes", "f.*")
    best = top_per_type(each.withColumn("score", V.cosine(F.col("target"), F.col("mood"))), list(fixed.LINEUP), ["festival"])
    return best.select("festival", "tagline", "type", "rn", "id", "score")


#: Moods up to this count are broadcast; more meet the items in so many parts of each type.
MOST_MOODS, TYPE_PARTS = 2_000, 64


def slot_candidates(pool: DataFrame, moods: DataFrame, slots: list | None = None) -> DataFrame:
    """(mood_id, slot, type_pos, id, score): of each mood, slot and type as many best items as there are slots.

    No more can be needed, as each slot uses up one item; a task keeps no more of what it sees before anything is moved. Few
    moods are broadcast, so the items stay where they are; many meet parts of the items, as there are only a few types.
    """
    slots = fixed.SLOTS if slots is None else slots
    wanted = F.array(*(F.struct(F.lit(k).alias("slot"), F.lit(p).alias("type_pos"), F.lit(t).alias("type"), vector_literal(target).alias("tone")) for k, (_, types, target) in enumerate(slots) for p, t in enumerate(types)))
    asked = moods.select("mood_id", F.col("mood").alias("asked"), F.explode(wanted).alias("w")).select("mood_id", "asked", "w.*")
    target = F.zip_with("asked", "tone", lambda b, s: V.clamp(b * 0.45 + s * 0.55))
    asked, items = asked.withColumn("target", target).drop("asked", "tone"), pool.select("id", "type", "mood")
    if moods.limit(MOST_MOODS + 1).count() <= MOST_MOODS:
        pairs = items.join(F.broadcast(asked), "type")
    else:
        parts = F.explode(F.sequence(F.lit(0), F.lit(TYPE_PARTS - 1)))
        pairs = items.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(TYPE_PARTS)).cast("int")).join(asked.withColumn("part", parts), ["type", "part"])
    order = Window.partitionBy("mood_id", "slot", "type_pos").orderBy(F.desc("score"), "id")
    return pairs.withColumn("score", V.cosine(F.col("target"), F.col("mood"))).withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= len(slots)).select("mood_id", "slot", "type_pos", "type", "id", "score")


def plan_weekend(pool: DataFrame, moods: DataFrame, used: list | None = None, slots: list | None = None) -> DataFrame:
    """(mood_id, slot_no, slot, type, id, score) for each row (mood_id, mood) of ``moods``; slots without items are left out.

    Slots are filled in order: types not used yet come first, in the slot's order, then the others; of the first type
    that has an unused item the best is taken. The fold runs over a bounded candidate list in the row, in the JVM.
    """
    slots = fixed.SLOTS if slots is None else slots
    found = slot_candidates(pool if not used else pool.where(~F.col("id").isin(*used)), moods, slots)
    lists = found.groupBy("mood_id").agg(F.collect_list(F.struct("slot", "type_pos", "type", "score", "id")).alias("options"))
    id_type = pool.schema["id"].dataType.simpleString()
    state = F.struct(F.array().cast(f"array<{id_type}>").alias("ids"), F.array().cast("array<string>").alias("types"), F.array().cast(f"array<struct<slot_no:int,type:string,id:{id_type},score:double>>").alias("picks"))

    def step(s: Column, slot: Column) -> Column:
        free = F.filter("options", lambda o: (o.slot == slot) & ~F.array_contains(s.ids, o.id))
        ordered = F.array_sort(F.transform(free, lambda o: F.struct(F.array_contains(s.types, o.type).alias("again"), o.type_pos.alias("pos"), (-o.score).alias("less"), o.id.alias("id"), o.type.alias("type"))))

        def take(best: Column) -> Column:
            pick = F.struct(slot.cast("int").alias("slot_no"), best.type.alias("type"), best.id.alias("id"), (-best.less).alias("score"))
            return F.when(best.isNull(), s).otherwise(F.struct(F.array_append(s.ids, best.id).alias("ids"), F.array_append(s.types, best.type).alias("types"), F.array_append(s.picks, pick).alias("picks")))

        return F.get(F.transform(F.array(F.get(ordered, 0)), take), 0)

    picks = F.aggregate(F.sequence(F.lit(0), F.lit(len(slots) - 1)), state, step, lambda s: s.picks)
    names = F.array(*(F.lit(name) for name, _, _ in slots))
    return lists.select("mood_id", F.explode(picks).alias("p")).select("mood_id", "p.slot_no", F.get(names, F.col("p.slot_no")).alias("slot"), "p.type", "p.id", "p.score")


def axis_class(value: Column) -> Column:
    return F.when(value >= 0.66, "high").when(value <= 0.34, "low").otherwise("mid")


def _agreeing(target: Column, keep: int) -> Column:
    """An item's axes that agree most with the target: (less, i, value), ties in axis order."""
    weight = lambda m, t: (1.0 - F.abs(m - t)) * (1.0 + F.abs(m - 0.5) * 2.0)
    listed = F.transform(F.arrays_zip(F.col("mood").alias("m"), target.alias("t")), lambda z, i: F.struct((-weight(z.m, z.t)).alias("less"), i.alias("i"), z.m.alias("value")))
    return F.slice(F.array_sort(listed), 1, keep)


def agreements(pool: DataFrame, target: Column, keep: int = 3) -> DataFrame:
    """(id, rn, axis, value, agreement): an item's axes that agree most with the target, ties in axis order."""
    axes = F.array(*(F.lit(a) for a in fixed.AXES))
    out = pool.select("id", F.posexplode(_agreeing(target, keep)).alias("pos", "a"))
    return out.select("id", (F.col("pos") + 1).alias("rn"), F.get(axes, F.col("a.i")).alias("axis"), F.col("a.value").alias("value"), (-F.col("a.less")).alias("agreement"))


def explanation(target: Column) -> Column:
    """The paragraph on an item: title, creator, year, pitch, agreeing axes, themes, arc."""
    top = _agreeing(target, 3)
    phrases = F.array(*(F.struct(F.lit(fixed.PHRASES[a][0]).alias("high"), F.lit(fixed.PHRASES[a][1]).alias("low")) for a in fixed.AXES))
    said = F.filter(F.transform(top, lambda a: F.when(a.value >= 0.66, F.get(phrases, a.i)["high"]).when(a.value <= 0.34, F.get(phrases, a.i)["low"])), lambda p: p.isNotNull())
    joined = F.when(F.size(said) == 1, F.get(said, 0)).otherwise(F.concat(F.array_join(F.slice(said, 1, F.greatest(F.size(said) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(said, -1)))
    themes = F.slice(F.coalesce("themes", F.array().cast("array<string>")), 1, 3)
    listed_themes = F.when(F.size(themes) == 1, F.get(themes, 0)).otherwise(F.concat(F.array_join(F.slice(themes, 1, F.greatest(F.size(themes) - 1, F.lit(0))), ", "), F.lit(" and "), F.element_at(themes, -1)))
    return F.concat_ws(
        " ",
        F.concat(F.lit("**"), F.col("title"), F.lit("** by "), F.col("creator"), F.lit(" ("), F.col("year").cast("string"), F.lit(").")),
        F.coalesce("pitch", F.lit("")),
        F.when(F.size(said) > 0, F.concat(F.lit("It is "), joined, F.lit(fixed.LINED_UP))),
        F.when(F.size(themes) > 0, F.concat(F.lit("It touches on "), listed_themes, F.lit("."))),
        F.when(F.coalesce(F.col("emotional_arc"), F.lit("")) != "", F.concat(F.col("emotional_arc"), F.lit("."))),
    )


def mood_pills(mood: Column) -> Column:
    """Up to eight axes far from neutral: axis, signed delta, arrow and bar width, the largest first, else one text."""
    axes = F.array(*(F.lit(a) for a in fixed.AXES))
    listed = F.transform(mood, lambda v, i: F.struct((-F.abs(F.round((v - 0.5) * 2, 2))).alias("less"), i.alias("i"), F.round((v - 0.5) * 2, 2).alias("delta"), (F.abs(v - 0.5) > 0.15).alias("far")))
    far = F.slice(F.array_sort(F.filter(listed, lambda x: x.far)), 1, 8)
    return F.transform(far, lambda x: F.struct(F.get(axes, x.i).alias("axis"), x.delta.alias("delta"), F.when(x.delta > 0, "↑").otherwise("↓").alias("arrow"), (F.abs(x.delta) * 80).cast("int").alias("bar")))
