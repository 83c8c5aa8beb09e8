"""Merkle fixity audit of WARC replicas.

Each record is hashed (SHA-256); records in offset order are the leaves of a tree.  A node hashes
its offset range and its children's hashes, ``FAN`` of them.  Replicas are compared from the root
down, and only children of nodes that differ are compared further, so locating damage costs as
many rows as there is damage, per level.

All of it is native: hashes by ``sha2``, levels by grouped aggregation over ``FAN`` children.

Defined results: null urls or html are empty; a null page_id sorts first; pages that share a
page_id are separate records, ordered by digest; records that one replica lacks are reported as
missing or extra; empty replicas are equal to each other; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stillwater.llm._ordered import with_offsets
from stillwater.llm._scratch import materialize

FAN = 16


def warc_records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, record (bytes), digest, n_bytes of each page."""
    html = F.coalesce(html_col, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url_col, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    record = F.encode(F.concat(head, html, F.lit("\r\n\r\n")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), record.alias("record"))
    return rows.withColumns({"digest": F.sha2("record", 256), "n_bytes": F.octet_length("record").cast("long")})


def in_order(records: DataFrame) -> DataFrame:
    """Records with pos and offset in the archive, which holds them in page_id order.  An audit needs no
    bytes here: drop ``record`` first, and only digests are shuffled."""
    return with_offsets(records, "page_id", "n_bytes", "digest")


def leaves(archive: DataFrame, hash_col: str | None = None) -> DataFrame:
    """idx, first (offset), last (offset after), hash of an archive's records: hashed anew from their bytes, or as
    ``hash_col`` has it."""
    hash_ = F.sha2("record", 256) if hash_col is None else F.col(hash_col)
    size = F.octet_length("record") if hash_col is None else F.col("n_bytes")
    return archive.select(F.col("pos").alias("idx"), F.col("offset").alias("first"), (F.col("offset") + size).alias("last"), hash_.alias("hash"))


def merkle_tree(leaf_rows: DataFrame) -> list[DataFrame]:
    """Levels of the tree from the leaves to the root (the last has one row; no row for an empty archive)."""
    levels = [materialize(leaf_rows, "merkle")]
    while True:
        top = levels[-1].agg(F.max("idx")).first()[0]
        if top is None or top == 0:
            return levels
        child = F.struct("idx", "first", "last", "hash")
        up = levels[-1].groupBy(F.floor(F.col("idx") / FAN).alias("idx")).agg(F.array_sort(F.collect_list(child)).alias("c"))  # FAN children
        body = F.concat_ws("|", F.element_at("c", 1)["first"].cast("string"), F.element_at("c", -1)["last"].cast("string"), F.array_join(F.transform("c", lambda x: x["hash"]), "|"))
        up = up.select("idx", F.element_at("c", 1)["first"].alias("first"), F.element_at("c", -1)["last"].alias("last"), F.sha2(body, 256).alias("hash"))
        levels.append(materialize(up, "merkle"))


def audit(one: list[DataFrame], two: list[DataFrame]) -> DataFrame:
    """idx, first, last (offset range, of the first replica where it has one), kind (changed, missing, extra) of
    the records in which two replicas differ: missing ones lack in the second."""
    height = max(len(one), len(two))
    wanted = None
    for level in range(height - 1, -1, -1):
        sides = [t[level] if level < len(t) else None for t in (one, two)]
        if sides[0] is None or sides[1] is None:
            continue  # trees of different heights differ at their roots; the lower levels tell where
        a, b = (s.select("idx", *(F.col(c).alias(f"{c}_{k}") for c in ("first", "last", "hash"))) for k, s in zip("ab", sides, strict=True))
        if wanted is not None:
            near = wanted.select(F.col("idx").alias("_up"))
            a, b = (s.withColumn("_up", F.floor(F.col("idx") / FAN)).join(near, "_up", "left_semi").drop("_up") for s in (a, b))
        differ = a.join(b, "idx", "full_outer").where(~(F.col("hash_a").eqNullSafe(F.col("hash_b")) & F.col("first_a").eqNullSafe(F.col("first_b"))))
        wanted = materialize(differ.select("idx", F.coalesce("first_a", "first_b").alias("first"), F.coalesce("last_a", "last_b").alias("last"), F.when(F.col("hash_a").isNull(), "extra").when(F.col("hash_b").isNull(), "missing").otherwise("changed").alias("kind")), "differ")
        if not wanted.take(1):
            break
    return wanted
