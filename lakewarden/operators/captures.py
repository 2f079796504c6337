"""Chat turns: measures of a turn, duplicates, retention, threads, recall and their summaries."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakewarden.functions import folds
from lakewarden.sources import shared, versioned

#: Bounds of a stored turn and of the store.
MOST_RECEIVED, MOST_CONTENT, MOST_ITEMS, MOST_BYTES, ITEM_BYTES, STARRED_BYTES = 20_480, 20_000, 5_000, 4 << 20, 320, 512 << 10
#: Bounds of a search: query lengths, newest turns, characters of each, characters shown, hits.
QUERY_LEAST, QUERY_MOST, NEWEST, PREFIX, SHOWN, HITS = 4, 160, 800, 4_000, 600, 5
GRAPH_PROMPTS, MOST_TAGS, TOP_TAGS, MOST_LISTED, RECENT = 150, 4, 15, 100, 5

#: Words, and the tag that each tells, in order. A word of capitals is not found in a lower-cased text.
KEYWORDS = (
    ("react", "React"), ("hooks", "React"), ("jsx", "React"), ("component", "React"), ("useState", "React"), ("useEffect", "React"), ("nextjs", "React"), ("next.js", "React"),
    ("python", "Python"), ("pip", "Python"), ("django", "Python"), ("flask", "Python"), ("pandas", "Python"), ("numpy", "Python"),
    ("javascript", "JavaScript"), ("typescript", "TypeScript"), ("node", "Node.js"), ("express", "Node.js"), ("npm", "Node.js"),
    ("css", "CSS"), ("html", "HTML"), ("tailwind", "CSS"),
    ("sql", "Database"), ("database", "Database"), ("mongodb", "Database"), ("postgres", "Database"), ("mysql", "Database"), ("redis", "Database"),
    ("api", "API"), ("rest", "API"), ("graphql", "API"), ("endpoint", "API"), ("fetch", "API"),
    ("docker", "DevOps"), ("kubernetes", "DevOps"), ("k8s", "DevOps"), ("ci/cd", "DevOps"), ("deploy", "DevOps"), ("nginx", "DevOps"),
    ("aws", "Cloud"), ("azure", "Cloud"), ("gcp", "Cloud"), ("cloud", "Cloud"), ("s3", "Cloud"), ("lambda", "Cloud"),
    ("security", "Security"), ("xss", "Security"), ("csrf", "Security"), ("auth", "Security"), ("oauth", "Security"), ("jwt", "Security"), ("vulnerability", "Security"), ("encryption", "Security"),
    ("ai", "AI/ML"), ("machine learning", "AI/ML"), ("model", "AI/ML"), ("neural", "AI/ML"), ("llm", "AI/ML"), ("gpt", "AI/ML"), ("transformer", "AI/ML"),
    ("git", "Git"), ("github", "Git"), ("merge", "Git"), ("branch", "Git"), ("commit", "Git"),
    ("test", "Testing"), ("jest", "Testing"), ("unittest", "Testing"), ("pytest", "Testing"), ("testing", "Testing"),
    ("debug", "Debugging"), ("error", "Debugging"), ("fix", "Debugging"), ("bug", "Debugging"), ("crash", "Debugging"), ("traceback", "Debugging"),
    ("write", "Writing"), ("essay", "Writing"), ("blog", "Writing"), ("email", "Writing"), ("letter", "Writing"),
    ("math", "Math"), ("calculate", "Math"), ("equation", "Math"), ("formula", "Math"),
)
#: What tells code, questions and requests to explain, and code for the estimate of tokens.
CODE = r"```|function\s|const\s|let\s|var\s|=>\s|class\s|import\s|def\s|return\s"
QUESTION = r"(?i)^(how|what|why|when|where|can|could|should|is|are|do|does)\s"
EXPLAIN = r"explain|describe|summarize|break down|walk me through"
CODE_TOKENS = r"```|def |function |class |import |const |var |\{|\}"


def tags(text: Column, low: Column | None = None) -> Column:
    """The first tags of a text: by keyword, then by form; ``General`` if it has none."""
    low = F.lower(text) if low is None else low
    found = [F.when(F.contains(low, F.lit(word)), tag) for word, tag in KEYWORDS]
    found += [F.when(text.rlike(CODE), "Code"), F.when(F.trim(text).rlike(QUESTION), "Question"), F.when(low.rlike(EXPLAIN), "Explanation")]
    some = F.slice(F.array_distinct(F.array_compact(F.array(*found))), 1, MOST_TAGS)
    return folds.let(some, lambda t: F.when(F.size(t) > 0, t).otherwise(F.array(F.lit("General"))))


def tags_or(tags: Column, category: Column) -> Column:
    """Tags, or the category where a turn has none (an empty list is one), or ``General``."""
    named = F.when(F.coalesce(category, F.lit("")) != "", category).otherwise("General")
    return F.coalesce(tags, F.array(named))


def tokens(text: Column) -> Column:
    """Estimated tokens: by characters, fewer to a token in code, and by words."""
    chars, words = F.length(text), F.size(F.split(F.trim(text), r"\s+"))
    by_chars = F.when(text.rlike(CODE_TOKENS), F.ceil(chars / 3.5)).otherwise(F.ceil(chars / 4))
    return F.when(F.coalesce(chars, F.lit(0)) == 0, 0).otherwise(F.greatest(by_chars, F.ceil(words * 1.33))).cast("long")


def clamped(text: Column, most: int = MOST_CONTENT) -> Column:
    """A text cut to a bound, with a note of how much is gone."""
    note = F.concat(F.lit("\n\n[… truncated: "), (F.length(text) - most).cast("string"), F.lit(" more characters]"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, most), note))


def received(text: Column, most: int = MOST_RECEIVED) -> Column:
    """A turn's text as it is taken in: cut to a bound, with a mark."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("\n[…truncated at 20KB]"))).otherwise(text)


def enriched(captures: DataFrame) -> DataFrame:
    """Clamped turns of two characters or more, with ``tokens``, ``tags`` and ``category`` of what was taken in."""
    rows = captures.where(F.length("content") >= 2).withColumn("__taken", received(F.col("content")))
    rows = rows.withColumns({"content": clamped(F.col("__taken")), "tokens": tokens(F.col("__taken")), "tags": tags(F.col("__taken"), F.lower("__taken"))})
    return rows.withColumn("category", F.element_at("tags", 1)).drop("__taken")


def tool_class(tool: Column) -> Column:
    low, out = F.lower(F.coalesce(tool, F.lit(""))), F.lit("default")
    for name in ("copilot", "perplexity", "claude", "gemini", "chatgpt"):
        out = F.when(F.contains(low, F.lit(name)), name).otherwise(out)
    return out


def without_repeats(captures: DataFrame) -> DataFrame:
    """Drops turns that repeat the one before them in content, tool and type.

    The order is one of the whole table, by time (null ones first) and id. The
    turns are dealt by ranges of it and written, so each range is compared
    within itself, its first turn with the last of the range before: of these
    there is one a range. Turns without content repeat nothing.
    """
    spark = captures.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = shared.new_path(spark, "turns")
    dealt = captures.repartitionByRange(tasks, F.col("ts").asc_nulls_first(), "id").withColumn("__range", F.spark_partition_id())
    dealt.write.parquet(path)
    said = F.struct("content", "tool", "type")
    rows = spark.read.schema(dealt.schema).parquet(path).withColumn("__said", said)
    order = (F.col("ts").asc_nulls_first(), F.col("id").asc_nulls_first())
    last = rows.groupBy("__range").agg(F.max_by("__said", F.struct(F.col("ts").isNotNull(), "ts", F.col("id").isNotNull(), "id")).alias("__last"))
    before = last.select("__range", F.lag("__last").over(Window.orderBy("__range")).alias("__before"))  # a row a range
    ordered = rows.withColumns({"__prior": F.lag("__said").over(Window.partitionBy("__range").orderBy(*order))})
    prior = F.coalesce("__prior", "__before")
    same = (prior["content"] == F.col("content")) & (prior["tool"].eqNullSafe(F.col("tool"))) & (prior["type"].eqNullSafe(F.col("type")))
    return ordered.join(F.broadcast(before), "__range").where(~F.coalesce(same, F.lit(False))).select(*captures.columns)


def _behind(last) -> Column:
    """The sizes behind one, in the order of :func:`_newest`."""
    ts = F.lit(False) if last.ts is None else F.col("ts").isNull() | (F.col("ts") < F.lit(last.ts))
    by_id = F.lit(False) if last.id is None else F.col("id").isNull() | (F.col("id") > last.id)
    same_ts, same_id = F.col("ts").eqNullSafe(F.lit(last.ts).cast("timestamp")), F.col("id").eqNullSafe(F.lit(last.id).cast("string"))
    rest = F.struct("starred", "cost") > F.struct(F.lit(last.starred), F.lit(last.cost).cast("long"))
    return ts | (same_ts & (by_id | (same_id & rest)))


def _newest() -> list[Column]:
    return [F.desc_nulls_last("ts"), F.asc_nulls_last("id"), F.col("starred"), F.col("cost")]


def retained(captures: DataFrame, most_items: int = MOST_ITEMS, most_bytes: int = MOST_BYTES, reserve: int = STARRED_BYTES, step: int = 10_000, most_step: int = 200_000) -> DataFrame:
    """The newest turns that fit a budget, with ``overflow``: whether a starred one took of the reserve.

    A turn that does not fit is skipped and later ones may fit. Turns that
    agree in time, id, star and size are alike and are counted first; turns
    that only share an id are turns of their own. Once a turn did not fit, no
    later one of the same size and star does, so of each size only the newest
    go on, as many as the budget holds: some 20 million sizes at most,
    whatever the table. The driver takes the next ``step`` of those that could
    still fit (twice as many each time, within a bound) and goes on behind
    them. Turns without a time come last, without an id after others.
    """
    spark, path = captures.sparkSession, shared.new_path(captures.sparkSession, "sizes")
    keyed = captures.withColumns({"__id": F.col("id").cast("string"), "__star": F.coalesce("starred", F.lit(False)), "__cost": (F.coalesce(F.length("content"), F.lit(0)) + ITEM_BYTES).cast("long")})
    alike = keyed.groupBy(F.col("ts").alias("ts"), F.col("__id").alias("id"), F.col("__star").alias("starred"), F.col("__cost").alias("cost")).agg(F.count("*").alias("n"))
    most = most_bytes + reserve
    ranked = alike.where(F.col("cost") <= most).withColumn("k", F.row_number().over(Window.partitionBy("cost", "starred").orderBy(*_newest())))
    ranked.where(F.col("k") <= max(1, most // ITEM_BYTES)).where(F.col("k") <= F.floor(F.lit(most) / F.col("cost"))).drop("k").write.parquet(path)
    sizes = spark.read.schema("ts timestamp, id string, starred boolean, cost long, n long").parquet(path)
    kept, taken, count, last = [], 0, 0, None
    while True:
        fits = (F.col("cost") <= most_bytes - taken) if count < most_items else F.lit(False)
        rows = sizes.where(fits | (F.col("starred") & (F.col("cost") <= most - taken)))
        batch = (rows if last is None else rows.where(_behind(last))).orderBy(*_newest()).limit(step).collect()
        for r in batch:
            main = min(r.n, max(0, most_items - count), max(0, (most_bytes - taken) // r.cost))
            spare = min(r.n - main, max(0, (most - taken - main * r.cost) // r.cost)) if r.starred else 0
            if main or spare:
                kept.append((r.ts, r.id, r.starred, r.cost, main, main + spare))
            taken, count = taken + (main + spare) * r.cost, count + main
        if len(batch) < step:
            break
        last, step = batch[-1], min(2 * step, most_step)
    chosen = F.broadcast(spark.createDataFrame(kept, "__ts timestamp, __own string, __starred boolean, __size long, __main int, __all int"))  # bounded by the budget
    found = keyed.join(chosen, F.col("ts").eqNullSafe(F.col("__ts")) & F.col("__id").eqNullSafe(F.col("__own")) & (F.col("__star") == F.col("__starred")) & (F.col("__cost") == F.col("__size")))
    place = F.row_number().over(Window.partitionBy("__ts", "__own", "__starred", "__size").orderBy(F.col("content")))
    numbered = found.withColumn("__place", place).where(F.col("__place") <= max(1, most // ITEM_BYTES)).where(F.col("__place") <= F.col("__all"))
    return numbered.select(*captures.columns, (F.col("__place") > F.col("__main")).alias("overflow"))


def threads(captures: DataFrame) -> DataFrame:
    """A row for each session: the last prompt (else the first turn), first tool, last time, most frequent tag, and counts."""
    rows = captures.select(F.coalesce("session_url", F.lit("unknown")).alias("url"), "type", "content", "tool", "ts", "id", "starred", F.posexplode_outer("tags").alias("place", "tag"))
    order, first = F.struct("ts", "id"), F.coalesce("place", F.lit(0)) == 0  # a row for each tag: what is told of a turn is told by its first
    said = F.when(first & (F.col("type") == "prompt"), order)
    by_tag = rows.groupBy("url", "tag").agg(
        F.max_by(F.when(said.isNotNull(), F.col("content")), said).alias("prompt"), F.max(said).alias("prompt_at"), F.min_by("content", order).alias("content"), F.min_by("tool", order).alias("tool"), F.min(order).alias("at"),
        F.max("ts").alias("last_time"), F.bool_or("starred").alias("has_starred"), F.count_if(first).alias("n_items"), F.count("tag").alias("n"), F.min(F.struct("ts", "id", "place")).alias("first"),
    )  # at most a row for each tag that a session has
    return by_tag.groupBy("url").agg(
        F.coalesce(F.max_by("prompt", "prompt_at"), F.min_by("content", "at")).alias("preview"), F.min_by("tool", "at").alias("tool"), F.max("last_time").alias("last_time"), F.bool_or("has_starred").alias("has_starred"), F.sum("n_items").alias("n_items"),
        F.coalesce(F.min_by("tag", F.when(F.col("n") > 0, F.struct(-F.col("n"), "first"))), F.lit("General")).alias("top_tag"),
    )


def listed(captures: DataFrame, search: str = "", tool: str = "ALL", kind: str = "ALL", starred: bool = False, most: int | None = MOST_LISTED) -> DataFrame:
    """Turns by a piece of their text, their tool and their type, newest first, the first of them."""
    rows = captures
    if search:
        rows = rows.where(F.contains(F.lower("content"), F.lit(search.lower())))
    if tool != "ALL":
        rows = rows.where(F.col("tool") == tool)
    if kind != "ALL":
        rows = rows.where(F.col("type") == kind)
    if starred:
        rows = rows.where("starred")
    rows = rows.orderBy(F.desc_nulls_last("ts"), "id")
    return rows if most is None else rows.limit(most)


def toggled(table: versioned.Table, which: Column) -> int:
    """Turns the star of some turns of a versioned table on or off; returns the version that has the change, of those rows alone."""
    return table.put(table.read().where(which).withColumn("starred", ~F.coalesce("starred", F.lit(False))))


def drilled(captures: DataFrame, node: str, value: str) -> DataFrame:
    """Turns of a node of the graph: those of a tool, with a content, or with a tag."""
    if node == "tool":
        return captures.where(F.col("tool") == value)
    if node == "item":
        return captures.where(F.col("content") == value)
    if node == "tag":
        return captures.where(F.array_contains(tags_or(F.col("tags"), F.col("category")), value))
    raise ValueError(f"a node is a tool, an item or a tag, not {node}")


def thread_of(captures: DataFrame, starred_id: str) -> DataFrame:
    """The turns of the session of a starred turn, in order. A turn that is not starred, or of no session, has none."""
    session = captures.where((F.col("id") == starred_id) & F.col("starred")).select("session_url")  # one row
    return captures.join(F.broadcast(session), "session_url", "left_semi").orderBy("ts", "id")


def threads_listed(captures: DataFrame, most: int | None = None) -> DataFrame:
    """Threads by the time of their last turn, the latest first."""
    rows = threads(captures).orderBy(F.desc_nulls_last("last_time"), "url")
    return rows if most is None else rows.limit(most)


def tool_breakdown(captures: DataFrame, as_of) -> DataFrame:
    """Turns of the last week by class of tool, with ``top``: the class that has most (of several, the one whose newest turn is the newest)."""
    week = captures.where(F.col("ts") > F.lit(as_of - timedelta(days=7)))
    counts = week.groupBy(tool_class(F.col("tool")).alias("tool")).agg(F.count("*").alias("n"), F.max("ts").alias("newest"))
    return counts.withColumn("top", F.row_number().over(Window.orderBy(F.desc("n"), F.desc("newest"), "tool")) == 1).drop("newest")  # a row a class


def graph_nodes(captures: DataFrame) -> DataFrame:
    """(id, kind, label) of the graph of the newest prompts: tools, tags, and each distinct content by its digest."""
    newest = captures.where(F.col("type") == "prompt").orderBy(F.desc("ts"), "id").limit(GRAPH_PROMPTS)
    made = F.concat(
        F.array(F.struct(F.concat(F.lit("tool:"), "tool").alias("id"), F.lit("tool").alias("kind"), F.col("tool").alias("label"))),
        F.transform("tags", lambda t: F.struct(F.concat(F.lit("cat:"), t).alias("id"), F.lit("category").alias("kind"), t.alias("label"))),
        F.array(F.struct(F.concat(F.lit("prompt:"), F.substring(F.sha2("content", 256), 1, 16)).alias("id"), F.lit("item").alias("kind"), F.substring("content", 1, 80).alias("label"))),
    )
    return newest.select(F.explode(made).alias("n")).select("n.*").distinct()


def recall(captures: DataFrame, query: str) -> DataFrame:
    """Among the newest turns the first prompts, by distinct content, that hold a query."""
    if not QUERY_LEAST <= len(query) <= QUERY_MOST:
        captures = captures.limit(0)
    newest = captures.orderBy(F.desc("ts"), "id").limit(NEWEST)
    hits = newest.where((F.col("type") == "prompt") & F.contains(F.lower(F.substring("content", 1, PREFIX)), F.lit(query.lower())))
    first = hits.groupBy("content").agg(F.min_by(F.struct("id", "type", "tool", "ts", "tags", "starred"), F.struct(-F.unix_micros("ts"), "id")).alias("r"))
    return first.select("r.*", F.substring("content", 1, SHOWN).alias("content"), F.length("content").alias("full_length")).orderBy(F.desc("ts"), "id").limit(HITS)


def stats(captures: DataFrame) -> DataFrame:
    return captures.agg(F.count("*").alias("n_items"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("n_tokens"), F.count_if(F.col("type") == "prompt").alias("n_prompts"), F.count_if(F.col("type") == "response").alias("n_responses"), F.count_if("starred").alias("n_starred"))


def tag_cloud(captures: DataFrame, most: int = TOP_TAGS) -> DataFrame:
    """The most frequent tags and the size each is shown at, from 10 to 16."""
    # outer, and filtered after: a filter on the array itself would tell the tags of each turn again below it
    counts = captures.select(F.explode_outer("tags").alias("tag")).where(F.col("tag").isNotNull()).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)
    return counts.withColumn("size", 10 + 6 * F.col("n") / F.max("n").over(Window.partitionBy(F.lit(1))))


def graph(captures: DataFrame) -> DataFrame:
    """(source, target) links of the newest prompts: from tools and tags to the digest of each distinct content."""
    newest = captures.where(F.col("type") == "prompt").orderBy(F.desc("ts"), "id").limit(GRAPH_PROMPTS)
    ends = F.explode(F.concat(F.array(F.concat(F.lit("tool:"), "tool")), F.transform("tags", lambda t: F.concat(F.lit("cat:"), t)))).alias("source")
    return newest.select(ends, F.concat(F.lit("prompt:"), F.substring(F.sha2("content", 256), 1, 16)).alias("target")).distinct()


#: Spans of time: days back, and the unit of a bucket.
FRAMES = {"day": (1, "hour"), "week": (7, "day"), "month": (30, "day"), "year": (365, "month"), "all": (5 * 365, "year")}


def buckets(captures: DataFrame, frame: str, as_of) -> DataFrame:
    """Turns by bucket of time and class of tool, with each class's share of its bucket in percent."""
    days, unit = FRAMES[frame]
    rows = captures.where(F.col("ts") >= F.lit(as_of - timedelta(days=days))).groupBy(F.date_trunc(unit, "ts").alias("at"), tool_class(F.col("tool")).alias("tool")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("at"))
    return rows.select(F.unix_seconds("at").alias("bucket"), "tool", "n", total.alias("total"), (100 * F.col("n") / total).alias("share"))


def week_over_week(captures: DataFrame, as_of) -> DataFrame:
    """Turns of the last week, of the week before, and the change in percent, half rounded up."""
    week, two = F.lit(as_of - timedelta(days=7)), F.lit(as_of - timedelta(days=14))
    rows = captures.where(F.col("ts") > two).agg(F.count_if(F.col("ts") > week).alias("this_week"), F.count_if(F.col("ts") <= week).alias("last_week"))
    change = F.when(F.col("last_week") == 0, F.when(F.col("this_week") > 0, 100).otherwise(0)).otherwise(F.floor((F.col("this_week") - F.col("last_week")) * 100 / F.col("last_week") + 0.5))
    return rows.withColumn("change", change.cast("long"))


def streak(captures: DataFrame, as_of, most: int = 365) -> DataFrame:
    """How many days in a row, back from the present one, have turns."""
    days = captures.select(F.to_date("ts").alias("day")).where((F.col("day") <= F.lit(as_of.date())) & (F.col("day") > F.lit(as_of.date() - timedelta(days=most)))).distinct()
    runs = days.withColumn("k", F.row_number().over(Window.orderBy(F.desc("day"))))  # at most a row for each day of a year
    return runs.agg(F.count_if(F.date_add("day", F.col("k") - 1) == F.lit(as_of.date())).alias("streak"))
