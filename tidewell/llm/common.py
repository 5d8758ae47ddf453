"""What the corpus operators share: table access, text expressions, checkpoints and connected components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.operators.graph import checkpoint_dir, components, saved  # noqa: F401

#: White space of the text contracts: space, and tab to carriage return.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_crc(doc_id: Column | str) -> Column:
    """CRC-32 of the id as text; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def rekeyed(df: DataFrame, key: str) -> DataFrame:
    """df with the key made anew, so that a join deals both its sides out and adaptive execution may split a hot key."""
    kind = dict(df.dtypes)[key]
    if kind == "string":
        return df.withColumn(key, F.concat(F.col(key), F.lit("")))
    if kind == "bigint":
        return df.withColumn(key, F.bitwise_not(F.bitwise_not(F.col(key))))
    return df


def bounded_batches(spark: SparkSession, size: int = 8 << 20) -> None:
    """Arrow batches bounded by bytes, so that long texts don't add up in a Python worker. A smaller bound that another
    operator has set stays, as frames may run after others are built."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(name, None)
    if now is None or not now.isdigit() or not 0 < int(now) <= size:
        spark.conf.set(name, str(size))


def apart(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs with its columns named c0, c1, ... in order, and these names by the old ones; so no column of the caller's
    meets one of an operator's own. The result goes back by toDF(*docs.columns)."""
    new = [f"c{i}" for i in range(len(docs.columns))]
    return docs.toDF(*new), dict(zip(docs.columns, new))


def row_digest(df: DataFrame) -> Column:
    """A struct of two 64-bit hashes of a whole row; rows are taken to be equal if both agree (at 10**12 rows the odds
    of one collision are below 10**-14). Columns with maps, which don't hash, count as their JSON."""
    parts = [F.to_json(F.struct(F.col(f"`{f.name}`"))) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema]
    return F.struct(F.xxhash64(*parts).alias("a"), F.xxhash64(F.lit("second"), *parts).alias("b"))


def key_filter(keys: DataFrame, log2: int) -> DataFrame:
    """(page, bitmap): a Bloom filter of the long column key, two cells a key."""
    return keys.select(F.explode(F.array(*key_cells(F.col("key"), log2))).alias("cell")).groupBy(F.floor(F.col("cell") / 32768).cast("long").alias("page")).agg(F.bitmap_construct_agg(F.col("cell") % 32768).alias("bitmap"))


def key_cells(key: Column, log2: int) -> list[Column]:
    """Two cells of a well-mixed key, one in each half of a filter of 2**log2 bits."""
    half = 1 << (log2 - 1)
    return [key.bitwiseAND(F.lit(half - 1)), F.shiftrightunsigned(key, 32).bitwiseAND(F.lit(half - 1)) + F.lit(half)]


def in_filter(df: DataFrame, key: Column, cells: DataFrame, log2: int, flag: str) -> DataFrame:
    """df with flag: false only if not all cells of the key are set. cells is broadcast: 2**log2 bits at most."""
    tests = []
    for i, cell in enumerate(key_cells(key, log2)):
        page, bits = f"_tw_page{i}", f"_tw_bits{i}"
        df = df.join(F.broadcast(cells.toDF(page, bits)), F.floor(cell / 32768).cast("long") == F.col(page), "left")
        at = (cell % 32768).cast("int")
        byte = F.conv(F.hex(F.substring(F.col(bits), F.shiftright(at, 3) + 1, F.lit(1))), 16, 10).cast("int")
        tests.append(F.coalesce(F.call_function("shiftright", byte, at % 8).bitwiseAND(F.lit(1)) == 1, F.lit(False)))
    return df.withColumn(flag, tests[0] & tests[1]).drop("_tw_page0", "_tw_bits0", "_tw_page1", "_tw_bits1")


def filter_bits(rows: int, bits_per_row: int = 16, most: int = 30) -> int:
    """log2 of a filter's bits: 16 a row, and never over 2**30 (128 MB), which bounds what is broadcast. Beyond 67
    million rows the filter fills up, and lets more rows be suspected in vain (of all rows 6 % at 5 * 10**8
    rows, a third at 10**9); results stay the same."""
    return max(16, min(most, (max(1, rows) * bits_per_row - 1).bit_length()))


def without(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """docs without the rows whose row_digest is in touched (digest, drop) with drop, and with one row of each digest
    there without it. A Bloom filter of the digests lets all other rows stay where they are."""
    names = [f"`{c}`" for c in docs.columns]
    touched = saved(touched.select("digest", "drop"))
    log2 = filter_bits(touched.count())
    key = F.col("_tw_digest.a")
    rows = in_filter(docs.withColumn("_tw_digest", row_digest(docs)), key, key_filter(touched.select(F.col("digest.a").alias("key")), log2), log2, "_tw_maybe")
    told = touched.groupBy(F.col("digest").alias("_tw_d")).agg(F.max("drop").alias("_tw_drop"))
    maybe = rows.where("_tw_maybe").join(told, F.col("_tw_digest") == F.col("_tw_d"), "left")
    once = maybe.where("_tw_drop = false").groupBy("_tw_digest").agg(F.first(F.struct(*names)).alias("_tw_row"))
    stay = maybe.where("_tw_drop is null").select(*names)
    return rows.where("not _tw_maybe").select(*names).union(stay).union(once.select(*[F.col("_tw_row").getField(c).alias(c) for c in docs.columns]))
