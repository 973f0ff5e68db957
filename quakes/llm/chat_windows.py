r"""Chat formatting in budgeted windows (native).

Prefix sums of turn tokens cut a conversation into turn-aligned spans: a turn whose
prefix sum falls into the k-th slot of ``budget // 2`` tokens belongs to the k-th
span.  Every later window repeats the system turn and as many whole turns before it
as fit into ``history`` tokens; repeated turns are outside the loss mask, so every
assistant text is a target exactly once.  A window stays within ``budget`` as long
as system turn, history and its last turn fit into the other half; a longer turn is
never cut.

A turn is ``<s>ROLE[INST]TEXT[/INST]</s>``.  Inside role and text ``\``, ``<`` and
``[`` become ``\e``, ``\l`` and ``\b``, so no control string can occur there and
the escape can be undone.  Tokens are counted as a quarter of the UTF-8 bytes
plus four for the marks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quakes.llm.common import store, table

OPEN, HEAD, TAIL, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escape(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_windows(turns: DataFrame, budget: int = 2048, history: int = 256) -> DataFrame:
    """``conv_id, window, text, n_context, loss_spans`` (start, length in code points;
    from 0) from rows ``conv_id, turn, role, text``.

    Null text or role counts as empty.  Rows go by turn, ties by role and text, null
    turns first.  Null ``conv_id`` is a conversation of its own.  Rows that repeat are
    turns of their own.  An empty table gives no windows.
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"))
    conv = Window.partitionBy("conv_id")
    rows = rows.withColumn("idx", F.row_number().over(conv.orderBy("turn", "role", "text")))
    system = (F.col("idx") == 1) & (F.col("role") == "system")
    rows = rows.withColumn("system", system).withColumn(
        "cost", F.when(F.col("system"), 0).otherwise(F.ceil(F.octet_length("text") / 4) + 4).cast("long")
    )
    by_turn = conv.orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("after", F.sum("cost").over(by_turn))
    rows = rows.withColumn("before", F.col("after") - F.col("cost"))
    rows = rows.withColumn("slot", F.floor(F.col("before") / (budget // 2)))
    new = (F.col("slot") != F.lag("slot").over(conv.orderBy("idx"))).cast("int")
    rows = rows.withColumn("new", F.coalesce(new, F.lit(0)))
    rows = rows.withColumn("span", F.sum("new").over(by_turn).cast("int"))
    rows = rows.withColumn("last", F.max("span").over(conv))
    rows = rows.withColumn("span_end", F.max("after").over(Window.partitionBy("conv_id", "span")))
    place = lambda w, fresh: F.struct(w.cast("int").alias("window"), fresh.alias("fresh"))
    own = place(F.col("span"), F.lit(True))
    again = (F.col("span") < F.col("last")) & (F.col("span_end") - F.col("before") <= history)
    places = (
        F.when(F.col("system"), F.transform(F.sequence(F.lit(0), F.col("last")), lambda w: place(w, w == 0)))
        .when(again, F.array(own, place(F.col("span") + 1, F.lit(False))))
        .otherwise(F.array(own))
    )
    parts = rows.select("conv_id", "idx", "role", "text", F.explode(places).alias("at"))
    front = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(HEAD))
    body = escape(F.col("text"))
    target = F.col("at.fresh") & (F.col("role") == "assistant")
    parts = parts.select(
        "conv_id",
        F.col("at.window").alias("window"),
        F.struct(
            F.col("at.fresh").alias("fresh"),
            "idx",
            F.concat(front, body, F.lit(TAIL + CLOSE)).alias("text"),
            F.length(front).alias("skip"),
            F.when(target, F.length(body)).alias("size"),
        ).alias("part"),
    )
    windows = parts.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("part")).alias("parts"))

    def step(acc: Column, p: Column) -> Column:
        span = F.struct((acc["at"] + p["skip"]).alias("start"), p["size"].alias("length"))
        return F.struct(
            (acc["at"] + F.length(p["text"])).alias("at"),
            F.when(p["size"].isNotNull(), F.array_append(acc["out"], span)).otherwise(acc["out"]).alias("out"),
        )

    first = F.struct(F.lit(0).alias("at"), F.expr("CAST(array() AS array<struct<start:int,length:int>>)").alias("out"))
    return windows.select(
        "conv_id",
        "window",
        F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"),
        F.size(F.filter("parts", lambda p: ~p["fresh"])).alias("n_context"),
        F.aggregate("parts", first, step, lambda a: a["out"]).alias("loss_spans"),
    )


def read_windows(windows: DataFrame) -> DataFrame:
    """``conv_id, window, turns`` (role and text of the window's own turns, unescaped),
    ``loss`` (the masked texts) and ``chars``, from formatted windows alone."""
    said = F.filter(F.split("text", CLOSE), lambda s: s != "")
    own = F.slice(said, F.col("n_context") + 1, F.greatest(F.size(said) - F.col("n_context"), F.lit(0)))
    front = lambda s: F.substring_index(s, HEAD, 1)

    def turn(s: Column) -> Column:
        role = unescape(F.substr(front(s), F.lit(len(OPEN) + 1), F.length(s)))
        body = F.substr(s, F.length(front(s)) + len(HEAD) + 1, F.length(s) - F.length(front(s)) - len(HEAD) - len(TAIL))
        return F.struct(role.alias("role"), unescape(body).alias("text"))

    loss = F.transform("loss_spans", lambda x: unescape(F.substr("text", x["start"] + 1, x["length"])))
    return windows.select(
        "conv_id", "window", F.transform(own, turn).alias("turns"), loss.alias("loss"), F.length("text").alias("chars")
    )


def op4_chat_windows(spark, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        "SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]')"
        " AS t(conv_id, turn, role, text)"
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = read_windows(store(format_windows(turns), "windows"))
    digest = read.select(
        "conv_id",
        F.struct(
            "window",
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "").alias("turns"),
            F.array_join("loss", "").alias("loss"),
        ).alias("w"),
        F.size("turns").cast("long").alias("n"),
        F.col("chars").cast("long").alias("chars"),
    )
    whole = digest.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), F.sort_array(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars")
    )
    said = F.array_join(F.transform("w", lambda x: x["turns"]), "")
    loss = F.array_join(F.transform("w", lambda x: x["loss"]), "")
    return whole.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
    )
