"""Benchmark decontamination by template canonicalisation, with DataFrame functions only.

Numbers, the units behind them and names (capitalised words inside a sentence) become typed
placeholders, all else lower-case words. A capitalised word that opens a text, sentence, line or quotation may
be a name or not: windows that hold one are posted both ways. Windows of WINDOW template tokens of every benchmark item are
hash-joined with those of every document, so a question with other numbers or names still meets
its template. A window counts when its slots are consistent with its alignment of document and item:
each value of the item stands for the one value of the document that most of its slots have there, and
windows that hold an outvoted slot, or one of a tied vote, are discarded. A document
is contaminated by an item when at least ``coverage`` of the item's windows count.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import written

WINDOW = 8
#: Items of fewer tokens are too common to tell anything and match nothing.
LEAST = 5
COVERAGE = 0.5
#: Benchmark windows up to which they are broadcast (some 16 bytes each); beyond, the join shuffles.
BROADCAST_ROWS = 500_000

#: Units that may follow a number.
UNITS = (
    "km cm mm m mi ft kg mg g t lb lbs oz l ml cl s ms min h hr hrs w kw kwh v a hz khz mhz ghz kb mb gb tb pa bar j kj cal kcal "
    "percent degrees meters metres kilometers kilometres miles feet inches yards grams kilograms pounds ounces tons liters litres "
    "gallons seconds minutes hours days weeks months years dollars euros cents usd eur gbp mph kph kmh"
).split()
_MARK = "\u0001"
#: Where a capitalised word opens a text, line, sentence, quotation or bracket.
_OPENS = r"(?<=^\s{0,8}|\n\s{0,8}|[.!?][\"'”’»)\]]{0,2}\s{1,3}|[\"'“„”«»‘(\[¿¡])"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once for a row: optimisers would copy it into each place, and into every step of a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def marked(text: Column) -> Column:
    """Lower-case tokens with single spaces; a placeholder token is its type, an equals sign and its value."""
    number = r"\d+(?:[.,:/]\d+)*"
    unit = rf"(?=\d)(?<![\p{{L}}\p{{N}}])({number}) ?(%|°c|°f|(?:{'|'.join(UNITS)})(?![\p{{L}}\p{{N}}]))"
    bare = rf"(?=\d)(?<![\p{{L}}\p{{N}}=.,:/])({number})(?![\p{{L}}\p{{N}}])"
    other = rf"[^\p{{L}}\p{{M}}\p{{N}}{_MARK}=%°.,:/]+|(?<!\d)[.,:/=%°](?<!{_MARK}(?:num|unit|name|open)=)|[.,:/](?!\d)"
    named = F.regexp_replace(text, r"(?=\p{Lu})(?<=[\p{Ll}\p{N},;:] )\p{Lu}[\p{L}\p{M}]*", f"{_MARK}name=$0")
    named = F.lower(F.regexp_replace(named, rf"(?=\p{{Lu}}){_OPENS}\p{{Lu}}[\p{{L}}\p{{M}}]*", f"{_MARK}open=$0"))
    numbers = lambda x: F.regexp_replace(F.regexp_replace(x, unit, f" {_MARK}num=$1 {_MARK}unit=$2 "), bare, f" {_MARK}num=$1 ")
    return _let(named, lambda x: F.trim(F.regexp_replace(F.when(x.rlike(r"\d"), numbers(x)).otherwise(x), other, " ")))


def template(marked_text: Column, names: bool = False) -> Column:
    """The template tokens: placeholders without their values; opening capitalised words are names, or else words."""
    told = lambda x: F.regexp_replace(x, f"{_MARK}open=", f"{_MARK}name=" if names else "")
    bare = _let(marked_text, lambda x: F.when(x.contains(_MARK), F.regexp_replace(told(x), rf"({_MARK}\w+)=\S*", "$1")).otherwise(x))
    return F.filter(F.split(bare, " +"), lambda x: x != "")


def _values(marked_text: Column) -> Column:
    """The tokens with their values; an opening capitalised word is a name's value."""
    return F.filter(F.split(F.regexp_replace(marked_text, f"{_MARK}open=", f"{_MARK}name="), " +"), lambda x: x != "")


def _windows(tokens: Column, size: Column) -> Column:
    """A hash for every window of ``size`` tokens, in order."""
    each = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(F.slice(h, i + 1, size)))
    return _let(F.transform(tokens, lambda x: F.xxhash64(x)), lambda h: F.when(F.size(h) >= size, each(h)))


def _both(size: Column) -> Column:
    """The windows of ``tokens`` and those of ``named`` in one array for each place, without repeats."""
    same = F.transform(_windows(F.col("tokens"), size), lambda x: F.array(x))
    apart = F.zip_with(_windows(F.col("tokens"), size), _windows(F.col("named"), size), lambda x, y: F.array_distinct(F.array(x, y)))
    return F.when(F.col("named").isNull(), same).otherwise(apart)


def _posted(base: DataFrame, sizes: list[int]) -> DataFrame:
    """doc_id, size, doc_at, window: the windows of _both for every document and size, hashed in generated code, a row for each place.

    A hash of several columns is that of the array of them, so windows of items and documents meet.
    """
    hashed = lambda c: F.transform(c, lambda x: F.xxhash64(x)).alias(c)
    places = base.select("doc_id", hashed("tokens"), hashed("named")).where(F.size("tokens") >= sizes[0])
    places = places.select("doc_id", "tokens", "named", F.explode(F.sequence(F.lit(0), F.size("tokens") - sizes[0])).alias("doc_at"))
    window = lambda c, n: F.when(F.col("doc_at") + n <= F.size(c), F.xxhash64(*[F.get(c, F.col("doc_at") + k) for k in range(n)]))
    named = lambda n: F.when(F.col("named").isNotNull(), window("named", n))
    made = places.select("doc_id", "doc_at", *[w(n).alias(f"{c}{n}") for n in sizes for c, w in (("w", lambda n: window("tokens", n)), ("v", named))])
    if len(sizes) == 1:
        n = sizes[0]
        each = F.when(F.col(f"v{n}").isNull() | (F.col(f"v{n}") == F.col(f"w{n}")), F.array(f"w{n}")).otherwise(F.array(f"w{n}", f"v{n}"))
        return made.select("doc_id", F.lit(n).alias("size"), "doc_at", F.explode(each).alias("window"))
    row = lambda n, x: F.struct(F.lit(n).alias("size"), x.alias("window"))
    rows = [row(n, x) for n in sizes for x in (F.col(f"w{n}"), F.when(F.col(f"v{n}") != F.col(f"w{n}"), F.col(f"v{n}")))]
    return made.select("doc_id", "doc_at", F.inline(F.array(*rows))).where("window is not null").select("doc_id", "size", "doc_at", "window")


def _read(texts: DataFrame, *keys: str) -> DataFrame:
    """keys, marked, tokens, and named: the tokens with opening words as names, null where there are none."""
    out = texts.select(*keys, marked(F.col("text")).alias("marked"))
    opened = F.when(F.col("marked").contains(f"{_MARK}open="), template(F.col("marked"), names=True))
    return out.select(*keys, "marked", template(F.col("marked")).alias("tokens"), opened.alias("named"))


def _items(benchmark: DataFrame, window: int, least: int) -> DataFrame:
    """item_id, values, size, n_windows, tokens and named tokens of every item that can match."""
    out = benchmark.where("item_id is not null and text is not null").dropDuplicates(["item_id", "text"])
    out = _read(out, "item_id").select("item_id", "tokens", "named", _values(F.col("marked")).alias("item_values"))
    out = out.withColumn("size", F.least(F.lit(window), F.size("tokens"))).where(f"size >= {least}")
    return out.withColumns({"n_windows": F.size("tokens") - F.col("size") + 1, "item_key": F.xxhash64("item_id", "tokens", "item_values")})


def contaminations(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, least: int = LEAST) -> DataFrame:
    """doc_id, item_id, n_windows, n_matched, coverage: a row for every document and item that contaminates it.

    docs: doc_id, text; benchmark: item_id, text; other columns are ignored. Null ids and texts,
    and items of fewer than ``least`` tokens, match nothing. Items with fewer than ``window`` tokens match
    as one window. A repeated item_id is contaminating if any of its texts is; rows that repeat a doc_id are one document.
    """
    items = written(_items(benchmark, window, least), "items")
    needles = written(items.select("item_key", "size", F.posexplode(_both(F.col("size"))).alias("at", "both")).select("item_key", "size", "at", F.explode("both").alias("window")), "needles")
    sizes = [r[0] for r in needles.select("size").distinct().collect()]  # at most ``window`` values
    if not sizes:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, n_windows int, n_matched long, coverage double")
    small = needles.count() <= BROADCAST_ROWS
    keys = needles.select("window", "size").distinct()
    base = _read(docs.where("doc_id is not null and text is not null"), "doc_id").select("doc_id", "tokens", "named")
    found = _posted(base, sorted(sizes))
    # which windows are the benchmark's at all; few are, so what follows is small
    hits = written(found.join(F.broadcast(keys) if small else keys, ["window", "size"], "left_semi"), "hits")
    places = hits.join(F.broadcast(needles) if small else needles, ["window", "size"]).select("doc_id", "item_key", "at", "doc_at")
    enough = places.groupBy("doc_id", "item_key", "at").count().groupBy("doc_id", "item_key").agg(F.count("*").alias("m"))
    facts = items.select("item_key", "item_id", "n_windows", "size", "item_values")
    enough = enough.join(facts.select("item_key", "n_windows"), "item_key").where(F.col("m") >= coverage * F.col("n_windows")).select("doc_id", "item_key")
    places = written(places.join(enough, ["doc_id", "item_key"], "left_semi"), "places")
    # an alignment is a distance between document and item; its slots are read where the item has any
    slots = facts.where(F.exists("item_values", lambda x: x.contains(_MARK)))
    read = places.join(slots, "item_key")
    doc_ids = read.select("doc_id").distinct()
    values = docs.select("doc_id", "text").join(doc_ids, "doc_id", "left_semi").select("doc_id", _values(marked(F.col("text"))).alias("doc_values"))
    aligned = read.groupBy("doc_id", "item_key").agg(F.collect_set(F.struct("at", "doc_at")).alias("met"), F.first("size").alias("size"))
    aligned = aligned.join(facts.select("item_key", "item_values"), "item_key").join(values, "doc_id")
    pairs = aligned.select("doc_id", "item_key", F.inline("met"), "size", "item_values", "doc_values")
    pairs = pairs.select(
        "doc_id",
        "item_key",
        (F.col("doc_at") - F.col("at")).alias("shift"),
        "at",
        F.explode(
            F.filter(
                F.transform(
                    F.sequence(F.lit(1), F.col("size")),
                    lambda k: F.struct((F.col("at") + k).alias("p"), F.get(F.col("item_values"), F.col("at") + k - 1).alias("x"), F.regexp_replace(F.get(F.col("doc_values"), F.col("doc_at") + k - 1), f"^{_MARK}\\w+=", "").alias("y")),
                ),
                lambda s: s["x"].contains(_MARK),
            )
        ).alias("slot"),
    )
    pairs = written(pairs.select("doc_id", "item_key", "shift", "at", "slot.*"), "slots")
    of_value = ["doc_id", "item_key", "shift", "x"]
    votes = pairs.groupBy(*of_value, "y").agg(F.count_distinct("p").alias("n"))
    most = votes.groupBy(*of_value).agg(F.max(F.struct("n", "y")).alias("top"), F.sort_array(F.collect_list("n"), False).alias("ns")).where("size(ns) > 1")
    most = most.select(*of_value, F.expr("if(ns[0] > ns[1], top.y, null)").alias("winner"))
    lost = pairs.join(most, of_value).where("winner is null or y != winner").select("doc_id", "item_key", "shift", "at").distinct()
    good = places.withColumn("shift", F.col("doc_at") - F.col("at")).join(lost, ["doc_id", "item_key", "shift", "at"], "left_anti")
    counted = good.groupBy("doc_id", "item_key", "at").count().groupBy("doc_id", "item_key").agg(F.count("*").alias("n_matched"))
    told = counted.join(facts.select("item_key", "item_id", "n_windows"), "item_key").withColumn("coverage", F.col("n_matched") / F.col("n_windows"))
    told = told.where(F.col("coverage") >= coverage)
    best = told.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "n_matched", "n_windows")).alias("best"))
    return best.select("doc_id", "item_id", "best.n_windows", "best.n_matched", "best.coverage")
