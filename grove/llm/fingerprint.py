"""Document fingerprints: one-permutation MinHash with optimal densification, in SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.llm.base import table

#: Bins of a fingerprint, as a power of two, low-order bits kept of each, words of a shingle, hashed probes before the ranked one.
BIN_BITS, KEPT_BITS, SHINGLE, PROBES = 7, 8, 5, 6
BINS = 1 << BIN_BITS
#: Code points that one group of neighbouring documents should hold; quantiles of the keys that are told apart, and of a
#: part between two of them; tasks that sort groups at most.
GROUP_CHARS, LEAVES, CUTS, MOST_TASKS = 8_000_000, 1024, 255, 1 << 16
SPACES = r"[\x20\x09-\x0D]+"


def _let(value: Column, use) -> Column:
    """use(value), with value computed once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def shingle_hashes(text: Column, k: int = SHINGLE) -> Column:
    """Sorted 64-bit hashes of the runs of k words; of the whole sequence where it is shorter; empty without words."""
    words = F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")

    def runs(w: Column) -> Column:
        n = F.size(w)
        each = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
        return F.when(n >= k, each).when(n > 0, F.array(F.xxhash64(F.concat_ws(" ", w)))).otherwise(F.array().cast("array<bigint>"))

    return F.sort_array(_let(words, runs))


def _bin(x: Column) -> Column:
    return F.shiftright(x, 64 - BIN_BITS) + (BINS // 2)


def densified(hashes: Column) -> Column:
    """The smallest hash of every bin. An empty bin borrows from the first occupied bin of its own random order of bins.

    That order is drawn by hashing (bin, attempt); should PROBES attempts all meet empty bins, the occupied bins are
    ranked by a hash of (bin, occupied bin). Both depend on nothing but which bins are occupied, so equal sets borrow
    alike, and two sets' borrowed values agree with the chance of their likeness.
    """

    def fill(mins: Column) -> Column:
        by_bin = F.map_from_arrays(F.transform(mins, _bin), mins)

        def borrow(m: Column) -> Column:
            def one(i: Column) -> Column:
                probes = [F.element_at(m, F.pmod(F.xxhash64(i, F.lit(t)), F.lit(BINS)).cast("bigint")) for t in range(PROBES)]
                ranked = F.array_min(F.transform(mins, lambda x: F.struct(F.xxhash64(i, _bin(x), F.lit(-1)).alias("r"), x.alias("x"))))["x"]
                return F.coalesce(F.element_at(m, i), *probes, ranked)

            return F.transform(F.sequence(F.lit(0).cast("bigint"), F.lit(BINS - 1).cast("bigint")), one)

        return F.when(F.size(mins) == BINS, mins).when(F.size(mins) == 0, mins).otherwise(_let(by_bin, borrow))

    return _let(hashes, lambda h: _let(F.filter(h, lambda x, i: (i == 0) | (_bin(x) != _bin(F.get(h, i - 1)))), fill))


def fingerprint(text: Column, k: int = SHINGLE) -> Column:
    """The low KEPT_BITS bits of every bin as packed hex, two digits a bin; '' for texts without words and null."""
    low = F.transform(densified(shingle_hashes(text, k)), lambda x: F.substring(F.hex(F.pmod(x, F.lit(1 << KEPT_BITS)) + (1 << KEPT_BITS)), 2, 2))
    return F.lower(F.array_join(low, ""))


def likeness(a: Column, b: Column) -> Column:
    """Similarity of two fingerprints from 0 to 1, corrected for bins that agree by chance. Two empty ones: 1; one: 0."""
    same = F.aggregate(F.sequence(F.lit(0), F.lit(BINS - 1)), F.lit(0), lambda s, i: s + (F.substr(a, i * 2 + 1, F.lit(2)) == F.substr(b, i * 2 + 1, F.lit(2))).cast("int"))
    chance = 2.0**-KEPT_BITS
    return F.when(a == b, F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (same / F.lit(float(BINS)) - chance) / (1 - chance)))


def _leaves(docs: DataFrame, key: str) -> tuple[list[int], int] | None:
    """Lower bounds of the leaves, quantiles of the key, and the code points of docs."""
    first = docs.agg(F.sum(F.length("text")).alias("n"), F.min(key).alias("lo")).first()
    if first["lo"] is None:
        return None
    wanted = max(1, min(LEAVES, -(-(first["n"] or 0) // GROUP_CHARS)))
    cuts = docs.agg(F.percentile_approx(key, [i / wanted for i in range(1, wanted)] or [0.5], 100 * LEAVES).alias("q")).first()["q"] if wanted > 1 else []
    return sorted({first["lo"], *cuts}), first["n"] or 0


def with_next(docs: DataFrame, key: str, carried: list[str]) -> DataFrame:
    """docs with next_<column> for each carried column: that of the next row by (key, hash of text), after the last the first.

    Rows travel once. Groups of neighbouring rows are sorted side by side; the first row of every group also visits the
    group before it, as a marker. Groups are cut at quantiles of the key, and again within parts that hold too many code
    points; a key that fills such a part alone is cut at quantiles of its texts' hashes, equal texts by row, so that no
    repeated id or row is a group's burden. Rows that repeat key and text stand side by side in any order, being equal. key:
    a long column without nulls. Columns of docs other than key, text and the carried ones may have any name.
    """
    found = _leaves(docs, key)
    if found is None:
        return docs.select("*", *[F.lit(None).cast(docs.schema[c].dataType).alias(f"next_{c}") for c in carried])
    lows, total = found
    bounds = F.array(*[F.lit(e).cast("bigint") for e in lows])
    high = F.shiftleft(F.shiftright(F.xxhash64("text"), 32), 32)
    # Within one run a scanned row keeps its number, also when its task is run again.
    low = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 32))
    rows = docs.select(F.struct("*").alias("doc"), F.col(key).alias("key"), (high + low).alias("sub"), F.length("text").alias("chars"))
    rows = rows.withColumn("leaf", F.size(F.filter(bounds, lambda b: b <= F.col("key"))).cast("int"))
    # At most LEAVES rows.
    held = rows.groupBy("leaf").agg(F.sum("chars").alias("chars"), F.min("key").alias("lo"), F.max("key").alias("hi")).collect()
    parts = {r["leaf"]: (min(CUTS + 1, -(-(r["chars"] or 0) // GROUP_CHARS)), r["lo"] == r["hi"]) for r in held}
    large = [leaf for leaf, (n, _) in parts.items() if n > 1]
    inner: list[tuple] = []
    if large:
        alone = [leaf for leaf in large if parts[leaf][1]]
        fine = F.when(F.col("leaf").isin(alone), F.col("sub")).otherwise(F.col("key"))
        cut = rows.where(F.col("leaf").isin(large)).groupBy("leaf").agg(F.percentile_approx(fine, [i / (CUTS + 1) for i in range(1, CUTS + 1)], 10_000).alias("q"))
        for leaf, q in cut.collect():
            n = parts[leaf][0]
            inner.append((leaf, sorted({q[i * (CUTS + 1) // n - 1] for i in range(1, n)}), parts[leaf][1]))
    # LEAVES * CUTS numbers at most.
    cuts = docs.sparkSession.createDataFrame(inner, "leaf int, cuts array<bigint>, alone boolean")
    fine = F.when(F.col("alone"), F.col("sub")).otherwise(F.col("key"))
    place = F.coalesce(F.size(F.filter("cuts", lambda c: c < fine)), F.lit(0))
    placed = rows.join(F.broadcast(cuts), "leaf", "left").select("doc", "key", "sub", (F.col("leaf").cast("bigint") * (CUTS + 1) + F.greatest(place, F.lit(0))).alias("group"))
    heads = placed.groupBy("group").agg(F.min(F.struct("key", "sub")).alias("head"))
    order = Window.orderBy("group")
    visits = heads.select(F.col("group").alias("own"), "head", F.coalesce(F.lag("group").over(order), F.max("group").over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("visit"))
    both = placed.join(F.broadcast(visits), (F.col("group") == F.col("own")) & (F.struct("key", "sub") == F.col("head")), "left")
    stops = F.array_compact(F.array(F.struct(F.col("group").alias("g"), F.lit(False).alias("marker")), F.when(F.col("visit").isNotNull(), F.struct(F.col("visit").alias("g"), F.lit(True).alias("marker")))))
    dealt = both.select("doc", "key", "sub", F.explode(stops).alias("stop")).select("doc", "key", "sub", F.col("stop.g").alias("group"), F.col("stop.marker").alias("marker"))
    # A task holds a few groups, whatever the session's number of shuffle partitions is.
    dealt = dealt.repartition(max(1, min(MOST_TASKS, total // GROUP_CHARS)), "group")
    near = Window.partitionBy("group").orderBy("marker", "key", "sub")
    return dealt.select("doc", "marker", F.struct(*[F.lead(F.col(f"doc.{c}")).over(near).alias(f"next_{c}") for c in carried]).alias("next")).where("not marker").select("doc.*", "next.*")


def fingerprints(docs: DataFrame, k: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row.

    The edited text: the last floor(n_chars / 2) code points replaced by the first as many (or all) of the next document
    by (doc_id, hash of text), null ids first, after the last the first. Null texts are empty; repeated ids are neighbours; a
    lone document is its own neighbour; empty tables give no rows. Other columns of docs are not read.
    """
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("sort_id", F.coalesce("doc_id", F.lit(-(1 << 63))))
    pairs = with_next(own.withColumn("fingerprint", fingerprint(F.col("text"), k)), "sort_id", ["text", "fingerprint"])
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = pairs.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half)))
    done = edited.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", fingerprint(F.col("edited"), k).alias("edited_fingerprint"), "next_fingerprint")
    return done.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
