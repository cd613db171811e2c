"""Which areas a conversation calls for, and the passages it gets: for a whole batch of queries at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..sources.storage import stored
from .index import Index, best_chunks, best_within, passage_text, ranked

# Fixed values of the model.
ACTIVE_FROM, MAX_ACTIVE, PASSAGES, BUDGET = 0.40, 4, 8, 9000
FULL, SINGLE, PARTLY, OVERLAP, PARTLY_WORDS = 1.0, 0.75, 0.6, 0.6, 3
SATURATION, ALIAS_PART, TEXT_PART, STRONG = 1.5, 0.8, 0.7, 0.5
SIGNAL_BOOST, PHRASE_BOOST, SPARE, FILL = 1.0, 0.3, 4, 0.35
#: Number of the candidates' last stage.
LAST = 1 << 20

#: How the reader must treat an area: by its authority, or `parked`.
RULES = {
    "ask": "HIGH-STAKES AREA. Ask which of the documents and general knowledge to use before relying on either.",
    "parked": "general knowledge was chosen over the documents here; the documents of this area were left out on purpose.",
    "project": "the documents are the authority. Where an answer would contradict them, state both sides and let the user decide.",
}


def signal_phrases(areas: DataFrame) -> DataFrame:
    """(id, nth, phrase, toks) of the phrases with any word that counts; areas: (id, signals)."""
    exploded = areas.select("id", F.posexplode("signals").alias("nth", "phrase"))
    return exploded.withColumn("all_toks", tokens(F.col("phrase"))).withColumn("toks", F.array_distinct("all_toks")).where(F.size("toks") > 0)


def signal_hits(queries: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, id, nth, phrase, toks, s) of the phrases that match a query: all words, or most of a longer phrase."""
    words_ = phrases.select("id", "nth", "phrase", "toks", F.explode("toks").alias("term"))
    met = words_.join(queries.select("query_id", "term"), "term").groupBy("query_id", "id", "nth", "phrase", "toks").agg(F.count("*").alias("met"))
    size = F.size("toks")
    part = F.col("met") / size
    s = F.when(F.col("met") == size, F.when(size >= 2, FULL).otherwise(SINGLE)).when((part >= OVERLAP) & (size >= PARTLY_WORDS), PARTLY * part)
    return met.withColumn("s", s).where("s is not null").drop("met")


def signal_scores(hits: DataFrame) -> DataFrame:
    """(query_id, id, sig, phrases, terms): best match, phrases in order, and their words, repeats kept."""
    ordered = F.array_sort(F.collect_list(F.struct("nth", "phrase", "toks")))
    return hits.groupBy("query_id", "id").agg(F.max("s").alias("sig"), ordered.alias("o")).select("query_id", "id", "sig", F.col("o.phrase").alias("phrases"), F.flatten("o.toks").alias("terms"))


def alias_scores(queries: DataFrame, aliases: DataFrame) -> DataFrame:
    """(query_id, id, ali, words): words of the query among the area's, weighed against its heaviest; aliases: (id, term, weight)."""
    top = aliases.groupBy("id").agg(F.max("weight").alias("top"))
    part = aliases.join(top, "id").select("id", "term", (F.col("weight") / F.when(F.col("top") > 0, F.col("top")).otherwise(1.0)).alias("w"))
    met = queries.select("query_id", "term", "pos").join(part, "term")
    said = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term"))), lambda x: x["term"])
    return met.groupBy("query_id", "id").agg(F.least(F.lit(1.0), F.sum("w") / SATURATION).alias("ali"), said.alias("words"))


def relevance(scores: DataFrame) -> DataFrame:
    """(query_id, id, rel): an area's best chunk against the best of all."""
    local = scores.groupBy("query_id", "id").agg(F.max("score").alias("own"))
    best = F.max("own").over(Window.partitionBy("query_id"))  # one row an area
    rel = F.when(F.col("best") > 0, F.col("own") / F.col("best")).otherwise(0.0)
    return local.withColumn("best", best).where("id is not null").select("query_id", "id", rel.alias("rel"))


def area_scores(queries: DataFrame, areas: DataFrame, sig: DataFrame, ali: DataFrame, rel: DataFrame) -> DataFrame:
    """Every query with every area it has evidence for; areas without any evidence score 0 and are left out."""
    seen = sig.select("query_id", "id").unionByName(ali.select("query_id", "id")).unionByName(rel.select("query_id", "id")).distinct()
    keys = ["query_id", "id"]
    joined = seen.join(sig, keys, "left").join(ali, keys, "left").join(rel, keys, "left").join(areas.select("id", "ord", "authority", "label"), "id")
    zero = F.lit(0.0)
    out = joined.withColumns({c: F.coalesce(c, zero) for c in ("sig", "ali", "rel")})
    return out.withColumn("score", 1 - (1 - F.col("sig")) * (1 - ALIAS_PART * F.col("ali")) * (1 - TEXT_PART * F.col("rel")))


def activated(scored: DataFrame) -> DataFrame:
    """Areas from the threshold up, ranked by score then order: state `active` for the first four, `parked` in training mode."""
    met = scored.where(F.round("score", 9) >= ACTIVE_FROM).withColumn("parked", F.col("authority") == "training")
    nth = F.row_number().over(Window.partitionBy("query_id", "parked").orderBy(F.desc(F.round("score", 9)), "ord"))
    return met.withColumn("nth", nth).where(F.col("parked") | (F.col("nth") <= MAX_ACTIVE)).withColumn("state", F.when(F.col("parked"), "parked").otherwise("active")).drop("parked")


def with_reasons(active: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Adds reasons: up to two phrases, up to four words as documents spell them, or else a strong text match."""
    said = active.select("query_id", "id", F.posexplode(F.slice("words", 1, 4)).alias("o", "term")).join(surfaces, "term", "left")
    shown = said.groupBy("query_id", "id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", F.coalesce("surface", "term").alias("w")))), lambda x: x["w"]), ", ").alias("shown"))
    joined = active.join(shown, ["query_id", "id"], "left")
    quoted = F.array_join(F.transform(F.slice("phrases", 1, 2), lambda p: F.concat(F.lit('"'), p, F.lit('"'))), ", ")
    sounds = F.when(F.size(F.coalesce("phrases", F.array().cast("array<string>"))) > 0, F.concat(F.lit("sounds like "), quoted))
    mentions = F.when(F.col("shown").isNotNull(), F.concat(F.lit("mentions "), F.col("shown")))
    strong = F.when(sounds.isNull() & mentions.isNull() & (F.col("rel") >= STRONG), F.lit("strong text match"))
    return joined.withColumn("reasons", F.array_compact(F.array(sounds, mentions, strong))).drop("shown")


def focused_terms(queries: DataFrame, active: DataFrame, phrases: DataFrame) -> DataFrame:
    """(query_id, domain_id, term, weight): the query, plus matched phrases' words, plus lightly every phrase's words."""
    own = active.where("state = 'active'").select("query_id", F.col("id").alias("domain_id"), "terms")
    plain = own.select("query_id", "domain_id").join(queries.select("query_id", "term", "weight"), "query_id")
    matched = own.select("query_id", "domain_id", F.explode("terms").alias("term"), F.lit(SIGNAL_BOOST).alias("weight"))
    light = own.where(F.size("terms") > 0).select("query_id", "domain_id").join(phrases.select(F.col("id").alias("domain_id"), F.explode("all_toks").alias("term")), "domain_id").withColumn("weight", F.lit(PHRASE_BOOST))
    return plain.unionByName(matched).unionByName(light).groupBy("query_id", "domain_id", "term").agg(F.sum("weight").alias("weight"))


def focused_hits(terms: DataFrame, index: Index, k: int = PASSAGES + SPARE) -> DataFrame:
    """The best chunks within each active area; k covers any quota."""
    return best_within(terms, index, ("query_id", "domain_id"), k)


def representatives(aliases: DataFrame, index: Index, k: int = 2) -> DataFrame:
    """The two chunks of each area that its six heaviest words find; the same for every query."""
    nth = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("weight"), "term"))
    top = aliases.withColumn("nth", nth).where("nth <= 6").select(F.col("id").alias("domain_id"), "term", F.lit(1.0).alias("weight"))
    return best_within(top, index, ("domain_id",), k)


def candidates(plain: DataFrame, focused: DataFrame, fallback: DataFrame, active: DataFrame, k: int = PASSAGES) -> DataFrame:
    """Everything that may become a passage, a row each time it may: (query_id, stage, kind, rank, chunk_id, domain_id, via, score, total).

    Stages in order: 0 the plain head, the place of each active area, a last one for the strong plain hits. Kinds: 0
    plain hits; 1 hits within an area; 2 representatives, of areas with a reason and without hits. total is the sum of the
    active areas' scores. At most 2 * k plain rows and 4 * (k + 4) of areas for each query, whatever the corpus.
    """
    total = F.sum("score").over(Window.partitionBy("query_id"))
    live = active.where("state = 'active'").select("query_id", F.col("id").alias("domain_id"), F.col("nth").cast("int").alias("stage"), F.col("score").alias("area"), total.alias("total"), (F.size("reasons") > 0).alias("evident"))
    hits = plain.where(F.col("rank") <= k).withColumn("best", F.max("score").over(Window.partitionBy("query_id")))
    strong = F.round(F.col("score") - FILL * F.col("best"), 9) >= 0
    said, zero = F.lit("question").alias("via"), F.lit(0.0)

    def row(stage, kind: int, via: F.Column, area: F.Column, total: F.Column, domain: F.Column) -> list:
        return ["query_id", stage.cast("int").alias("stage"), F.lit(kind).alias("kind"), F.col("rank").cast("int").alias("rank"), F.col("chunk_id").cast("long").alias("chunk_id"), domain.alias("domain_id"), via.alias("via"), area.alias("area"), total.alias("total")]

    own = F.coalesce(F.col("id").cast("string"), F.lit(""))
    head = hits.where(F.col("rank") <= max(2, k // 3)).select(*row(F.lit(0), 0, said, zero, zero, own))
    last = hits.where(strong).select(*row(F.lit(LAST), 0, said, zero, zero, own))
    known = hits.select("query_id", "chunk_id", F.lit("question").alias("known"))
    within = live.join(focused.drop("score"), ["query_id", "domain_id"]).join(known, ["query_id", "chunk_id"], "left")
    bare = live.where("evident").join(focused.select("query_id", "domain_id"), ["query_id", "domain_id"], "left_anti")
    instead = bare.join(fallback.drop("score"), "domain_id").join(known, ["query_id", "chunk_id"], "left")
    via = F.coalesce("known", F.lit("area"))
    return head.unionByName(last).unionByName(within.select(*row(F.col("stage"), 1, via, F.col("area"), F.col("total"), F.col("domain_id")))).unionByName(
        instead.select(*row(F.col("stage"), 2, via, F.col("area"), F.col("total"), F.col("domain_id")))
    )


def assembled(rows: DataFrame, k: int = PASSAGES, budget: int = BUDGET) -> DataFrame:
    """(query_id, n, chunk_id, domain_id, via) of candidates with their length (chars) and whether their area is parked.

    A fold over each query's candidates in order. An area's quota is its share of the passages that are left when its
    turn comes; of its hits the first quota + 4 are tried, of representatives two. The first passage fits any budget.
    """
    ordered = F.array_sort(F.collect_list(F.struct("stage", "kind", "rank", "chunk_id", "domain_id", "via", "area", "total", "chars", "parked")))
    start = F.struct(
        F.array().cast("array<struct<chunk_id:bigint,domain_id:string,via:string>>").alias("taken"),
        F.lit(0).alias("used"), F.lit(-1).alias("stage"), F.lit(0).alias("quota"), F.lit(0).alias("got"),
    )

    def step(state, c):
        fresh, taken = c["stage"] != state["stage"], state["taken"]
        left = k - F.size(taken)
        share = F.when(c["total"] > 0, F.ceil(F.round(left * c["area"] / c["total"], 9))).otherwise(1)
        quota = F.when(fresh, F.when(c["kind"] == 0, k).otherwise(F.greatest(F.lit(1), share))).otherwise(state["quota"]).cast("int")
        got = F.when(fresh, 0).otherwise(state["got"])
        tried = F.when(c["kind"] == 1, quota + SPARE).when(c["kind"] == 2, F.least(F.lit(2), quota)).otherwise(k)
        room = (left > 0) & ((F.size(taken) == 0) | (state["used"] + c["chars"] <= budget))
        fits = (got < quota) & (c["rank"] <= tried) & room & ~c["parked"] & ~F.exists(taken, lambda x: x["chunk_id"] == c["chunk_id"])
        more = F.array(F.struct(c["chunk_id"].alias("chunk_id"), c["domain_id"].alias("domain_id"), c["via"].alias("via")))
        return F.struct(
            F.when(fits, F.concat(taken, more)).otherwise(taken).alias("taken"),
            (state["used"] + F.when(fits, c["chars"]).otherwise(0)).cast("int").alias("used"),
            c["stage"].alias("stage"), quota.alias("quota"), (got + fits.cast("int")).cast("int").alias("got"),
        )

    folded = rows.groupBy("query_id").agg(ordered.alias("all")).select("query_id", F.aggregate("all", start, step, lambda x: x["taken"]).alias("taken"))
    return folded.select("query_id", F.posexplode("taken").alias("n", "p")).select("query_id", (F.col("n") + 1).cast("int").alias("n"), "p.*")


def pack_passages(plain: DataFrame, focused: DataFrame, fallback: DataFrame, active: DataFrame, index: Index, k: int = PASSAGES, budget: int = BUDGET) -> DataFrame:
    """(query_id, n, doc, section, text, domain_id, via) of every query. Only the candidates meet the chunk tables."""
    rows = candidates(plain, focused, fallback, active, k)
    parked = active.where("state = 'parked'").select("query_id", F.col("id").alias("domain_id"), F.lit(True).alias("shut"))
    rows = rows.join(parked, ["query_id", "domain_id"], "left").withColumn("parked", F.coalesce("shut", F.lit(False)))
    found = assembled(rows.join(index.lengths.select("chunk_id", "chars"), "chunk_id"), k, budget)
    return found.join(index.chunks.select("chunk_id", "doc", "section", passage_text(F.col("text")).alias("text")), "chunk_id").select("query_id", "n", "doc", "section", "text", "domain_id", "via")


def resolve(queries: DataFrame, areas: DataFrame, aliases: DataFrame, surfaces: DataFrame, index: Index, k: int = PASSAGES, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """Activations and passages of every query (query_id, term, weight, pos); what several steps read is written once.

    areas: (ord, id, label, authority, signals); aliases: (id, term, weight); surfaces: (term, surface).
    """
    phrases, scores = signal_phrases(areas), stored(best_chunks(queries, index, k), "best")
    scored = area_scores(queries, areas, signal_scores(signal_hits(queries, phrases)), alias_scores(queries, aliases), relevance(scores))
    active = stored(with_reasons(activated(scored), surfaces), "active")
    focused = stored(focused_hits(focused_terms(queries, active, phrases), index, k + SPARE), "focused")
    return active, pack_passages(ranked(scores, k=k), focused, representatives(aliases, index), active, index, k, budget)


def authority_rules(active: DataFrame) -> DataFrame:
    """(query_id, rules): how the reader must treat each area, active areas first."""
    rule = F.when(F.col("state") == "parked", RULES["parked"]).when(F.col("authority") == "ask", RULES["ask"]).otherwise(RULES["project"])
    line = F.concat(F.lit("- "), "label", F.lit(": "), rule)
    ordered = F.array_sort(F.collect_list(F.struct("state", "nth", line.alias("line"))))
    return active.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("rules"))
