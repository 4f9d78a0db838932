"""Tables continued over page breaks.

Whether a table continues a run depends on the *first* table of that run (its
page and its headers), so runs are a sequential fold along the document.  The
fold is cut into blocks of at most ``width`` nodes:

1. every block becomes a map from the head that enters it to the head that
   leaves it: a short list of *breaks* (see ``breaks``) with the head that the
   block ends with when the entering head is first broken there;
2. maps of neighbouring blocks are composed pairwise, level by level;
3. entering heads are passed down again through the levels;
4. every block is folded once more from its entering head.

A task composes two maps at a time, whatever the length of the document.
Documents of one block skip steps 1 to 3.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..fixed_values import WEAK_TEXT_LENGTH
from ..functions.hof import BLANK_CHARS, strip
from ..functions.tables import TABLE_TYPE, fit_rows, header_keys, header_key, notation_and_table, table_struct
from ..session import cut_lineage, written_once
from .segmented import carry_last, running_total

BLOCK = 4096
_SIG = "page int, sep bigint, usable boolean, headers array<string>"


def is_weak(kind: Column, content: Column) -> Column:
    """Short text that may stand between two halves of a table."""
    length = F.length(F.btrim(F.coalesce(content, F.lit("")), F.lit(BLANK_CHARS)))
    return kind.isin("TEXT", "SECTION_HEADER", "TITLE") & (length > 0) & (length < WEAK_TEXT_LENGTH)


def parsed_tables(nodes: DataFrame, keys: list[str], position: str = "ord", skip_weak: bool = True) -> DataFrame:
    """Table nodes with parsed content and the count of hard separators before them."""
    kind = F.col("type")
    separator = kind != "TABLE"
    if skip_weak:
        separator = separator & ~is_weak(kind, F.col("content"))
    counted = running_total(nodes, keys, position, F.when(separator, 1).otherwise(0), "sep", inclusive=False)
    return counted.where(kind == "TABLE").withColumn("_read", notation_and_table(F.col("content"))).withColumns(
        {
            "table": F.col("_read.table"),
            "usable": F.col("_read.notation").isin("json", "otsl", "markdown") & (F.size("_read.table.headers") > 0),
            "header_keys": header_keys(F.col("_read.table.headers")),
        }
    ).drop("_read")


# Signature of a table: (page, separators before, usable, header keys).


def _continues_assembly(head, table) -> bool:
    if head[1] != table[1] or not (head[2] and table[2]):
        return False
    if head[0] > 0 and table[0] > 0 and table[0] not in (head[0], head[0] + 1):
        return False
    a, b = set(head[3]), set(table[3])
    return a == b or len(a & b) >= max(2, int(0.8 * min(len(a), len(b))))


def _continues_page(head, table) -> bool:
    return head[1] == table[1] and table[0] == head[0] + 1


MODES = {"assembly": _continues_assembly, "page": _continues_page}


def _signatures(rows) -> list[tuple]:
    return [
        (int(r["page"] or 0), int(r["sep"]), bool(r["usable"]), tuple(r["headers"] if r["headers"] is not None else ()))
        for r in rows
    ]


def _fold(positions, signatures, head, continues) -> list:
    """Head position of every table."""
    out = []
    for at, sig in zip(positions, signatures):
        if head is None or not continues(head[1], sig):
            head = (at, sig)
        out.append(head[0])
    return out


def breaks(tables: list[tuple], mode: str) -> list[int]:
    """Places among ``(position, signature, …)`` where an entering head can be broken first.

    A repeated signature breaks no head that its first occurrence let pass.
    Another separator count, or a table that cannot be joined, breaks every
    head, so the list ends there.  In page mode so does another page.  Heads of
    a known page pass no table two pages away from the first: from there on
    only heads without a page matter, and for those a table's page does not.
    """
    out: list[int] = []
    seen: set = set()
    paged: int | None = None
    known = True
    for i, (_, (page, sep, usable, headers), *_) in enumerate(tables):
        if not out:
            first_page, first_sep = page, sep
        if sep != first_sep or (mode == "page" and page != first_page) or (mode == "assembly" and not usable):
            out.append(i)
            break
        if mode == "page":
            if not out:
                out.append(i)
            continue
        new = {("any", frozenset(headers))}
        if known:
            new.add((page, frozenset(headers)))
            if page > 0:
                paged = page if paged is None else paged
                known = abs(page - paged) < 2
        if not new <= seen:
            seen |= new
            out.append(i)
    return out


def block_map(positions: list[int], signatures: list[tuple], mode: str) -> list[tuple]:
    """The block's map: ``(position, signature, leaving position, leaving signature)`` for each break."""
    continues = MODES[mode]
    leaving: dict[int, int] = {}

    def last_head(i: int) -> int:
        chain = []
        while i not in leaving:
            chain.append(i)
            j = i + 1
            while j < len(signatures) and continues(signatures[i], signatures[j]):
                j += 1
            if j == len(signatures):
                leaving[i] = i
            i = j if j < len(signatures) else i
        for c in chain:
            leaving[c] = leaving[i]
        return leaving[i]

    tables = list(zip(positions, signatures))
    return [(*tables[i], *tables[last_head(i)]) for i in breaks(tables, mode)]


def left_by(map_: list[tuple], head: tuple | None, mode: str) -> tuple | None:
    """The head ``(position, signature)`` that leaves a block (or several) when ``head`` enters."""
    for _, signature, at, leaving in map_:
        if head is None or not MODES[mode](head[1], signature):
            return at, leaving
    return head


def composed(left: list[tuple], right: list[tuple], mode: str) -> list[tuple]:
    """The map of two neighbouring stretches."""
    if not left or not right:
        return left or right
    ends: dict[tuple, tuple] = {}
    rows = []
    for at, signature, *exit_ in left:
        key = tuple(exit_)
        if key not in ends:
            ends[key] = left_by(right, key, mode)
        rows.append((at, signature, *ends[key]))
    rows += right
    return [rows[i] for i in breaks(rows, mode)]


def _map_type(key_types: list) -> T.StructType:
    signature = T.StructType.fromDDL(_SIG).fields
    return T.StructType([
        *key_types, T.StructField("node", T.LongType()), T.StructField("place", T.IntegerType()), T.StructField("at", T.LongType()),
        *signature, T.StructField("exit_at", T.LongType()), *[T.StructField(f"exit_{f.name}", f.dataType) for f in signature],
    ])


def _map_rows(head: list, node: int, map_: list[tuple]) -> list[list]:
    """Rows of a map; place -1 is left for entering heads."""
    return [[*head, node, i, at, *sig[:3], list(sig[3]), to, *end[:3], list(end[3])] for i, (at, sig, to, end) in enumerate(map_)]


def _map_of(rows: list) -> list[tuple]:
    def head(r, prefix):
        page, sep, usable, headers = (r[prefix + f] for f in ("page", "sep", "usable", "headers"))
        return int(r[prefix + "at"]), (int(page), int(sep), bool(usable), tuple(headers))

    return [(*head(r, ""), *head(r, "exit_")) for r in sorted(rows, key=lambda r: r["place"])]


def entering_heads(maps: DataFrame, keys: list[str], levels: int, mode: str) -> DataFrame:
    """Per block with an entering head a row of the map's type whose exit is that head.

    ``maps``: the blocks' maps, ``node`` is the block's number, below ``2 ** levels``.
    """
    kind = maps.schema
    names = kind.fieldNames()
    rest = [c for c in names if c not in keys]

    def paired(level: DataFrame, work) -> DataFrame:
        """``work(keys, rows of two nodes)`` gives rows; a record holds the maps of two neighbours."""
        pairs = level.groupBy(*keys, "_parent").agg(F.collect_list(F.struct(*rest)).alias("rows"))

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = [row for rec in batch.to_dict("records") for row in work([rec[k] for k in keys], list(rec["rows"]))]
                yield pd.DataFrame(out, columns=names)

        return cut_lineage(pairs.mapInPandas(run, kind))

    def compose(head: list, rows: list) -> list[list]:
        sides = [_map_of([r for r in rows if r["node"] % 2 == side]) for side in (0, 1)]
        return _map_rows(head, int(rows[0]["node"]) // 2, composed(*sides, mode))

    def hand_down(head: list, rows: list) -> list[list]:
        given = [r for r in rows if r["place"] < 0]
        entering = _map_of(given)[0][2:] if given else None
        out = []
        for node in sorted({r["node"] for r in rows if r["place"] >= 0}):
            if entering is not None:
                at, sig = entering
                out.append([*head, int(node), -1, at, *sig[:3], list(sig[3]), at, *sig[:3], list(sig[3])])
            entering = left_by(_map_of([r for r in rows if r["node"] == node and r["place"] >= 0]), entering, mode)
        return out

    up = [cut_lineage(maps)]
    for _ in range(levels - 1):
        up.append(paired(up[-1].withColumn("_parent", F.shiftright("node", 1)), compose))
    entering = None
    for level in reversed(up):
        below = level.withColumn("_parent", F.shiftright("node", 1))
        if entering is not None:
            below = below.unionByName(entering.withColumn("_parent", F.col("node")))
        entering = paired(below, hand_down)
    return entering


def table_heads(tables: DataFrame, keys: list[str], position: str = "ord", mode: str = "assembly", width: int = BLOCK) -> DataFrame:
    """(keys, position, head): the first table of the run each table belongs to."""
    key_types = [T.StructField(k, tables.schema[k].dataType) for k in keys]
    block = F.floor(F.col(position) / width).alias("block")
    row = F.struct(
        F.col(position).cast("long").alias("at"), F.coalesce("page", F.lit(0)).cast("int").alias("page"),
        F.col("sep").cast("long").alias("sep"), F.coalesce("usable", F.lit(False)).alias("usable"), F.col("header_keys").alias("headers"),
    )
    blocks = tables.groupBy(*keys, block).agg(F.array_sort(F.collect_list(row)).alias("rows"))
    out_type = T.StructType([*key_types, T.StructField(position, T.LongType()), T.StructField("head", T.LongType())])
    # one number: how many levels the longest document needs
    last = tables.agg(F.max(F.floor(F.col(position) / width))).first()[0]
    levels = int(last or 0).bit_length()
    entered = blocks.withColumn("entering", F.lit(None).cast(T.StructType.fromDDL(f"at bigint, {_SIG}")))
    if levels:
        blocks = cut_lineage(blocks)
        several = blocks.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
        kind = _map_type(key_types)

        def summarise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                out = []
                for rec in batch.to_dict("records"):
                    map_ = block_map([int(r["at"]) for r in rec["rows"]], _signatures(rec["rows"]), mode)
                    out += _map_rows([rec[k] for k in keys], int(rec["block"]), map_)
                yield pd.DataFrame(out, columns=kind.fieldNames())

        maps = blocks.join(several, keys, "left_semi").mapInPandas(summarise, kind)
        head = F.struct(F.col("exit_at").alias("at"), *[F.col(f"exit_{f.name}").alias(f.name) for f in T.StructType.fromDDL(_SIG)])
        entering = entering_heads(maps, keys, levels, mode).select(*keys, F.col("node").alias("block"), head.alias("entering"))
        entered = blocks.join(entering, [*keys, "block"], "left")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("rows")
            sizes = lists.value_lengths().to_numpy(zero_copy_only=False)
            tables = lists.flatten()
            at, page, sep, usable, headers = (tables.field(f) for f in ("at", "page", "sep", "usable", "headers"))
            positions = at.to_pylist()
            signatures = list(zip(page.to_pylist(), sep.to_pylist(), usable.to_pylist(), map(tuple, headers.to_pylist())))
            heads: list[int] = []
            begin = 0
            for size, given in zip(sizes.tolist(), batch.column("entering").to_pylist()):
                head = (int(given["at"]), _signatures([given])[0]) if given is not None else None
                heads += _fold(positions[begin : begin + size], signatures[begin : begin + size], head, MODES[mode])
                begin += size
            of = pa.array(np.repeat(np.arange(batch.num_rows), sizes))
            columns = [*(batch.column(k).take(of) for k in keys), at, pa.array(heads, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, out_type.fieldNames())

    return entered.mapInArrow(assign, out_type)


def aligned_rows(table: Column, head: Column, mode: str) -> Column:
    """Rows of a continuing table under the head's headers."""
    if mode == "page":
        first = F.transform(F.coalesce(F.get(table["rows"], F.lit(0)), F.array().cast("array<string>")), strip)
        same = table["headers"] == head["headers"]
        repeat = first == F.transform(head["headers"], strip)
        rest = F.slice(table["rows"], F.lit(2), F.size(table["rows"]))
        return F.when(same, table["rows"]).when(repeat, rest).otherwise(fit_rows(head["headers"], table["rows"]))
    own = F.transform(table["headers"], header_key)
    places = F.transform(head["headers"], lambda h: F.array_position(own, header_key(h)).cast("int"))
    return F.transform(
        table["rows"],
        lambda r: F.transform(places, lambda p: F.when(p > 0, F.coalesce(F.get(r, p - 1), F.lit(""))).otherwise("")),
    )


def stitched_rows(nodes: DataFrame, keys: list[str], position: str = "ord", mode: str = "assembly", width: int = BLOCK) -> DataFrame:
    """Rows of all runs: keys, head, part (position of the table), row, headers, values."""
    # parsed once: heads, parts and headers of heads each read their columns
    tables = written_once(parsed_tables(nodes, keys, position, skip_weak=mode == "assembly").select(
        *keys, position, "page", "sep", "usable", "header_keys", "table"
    ), "tables")
    heads = table_heads(tables, keys, position, mode, width)
    parts = tables.select(*keys, position, "table").join(heads, [*keys, position])
    of_head = tables.select(
        *keys, F.col(position).cast("long").alias("head"), F.struct(F.col("table.headers").alias("headers")).alias("head_table")
    )
    joined = parts.join(of_head, [*keys, "head"])
    rows = F.when(F.col(position) == F.col("head"), F.col("table.rows")).otherwise(
        aligned_rows(F.col("table"), F.col("head_table"), mode)
    )
    return joined.select(
        *keys, "head", F.col(position).alias("part"), F.col("head_table.headers").alias("headers"), F.posexplode(rows).alias("row", "values")
    )


def stitched_tables(nodes: DataFrame, keys: list[str], position: str = "ord", mode: str = "assembly", width: int = BLOCK) -> DataFrame:
    """One table per run.  The size of a row here is the size of the merged table."""
    rows = stitched_rows(nodes, keys, position, mode, width)
    ordered = F.array_sort(F.collect_list(F.struct("part", "row", "values")))
    return rows.groupBy(*keys, "head").agg(
        F.first("headers").alias("headers"), F.count_distinct("part").alias("parts"),
        F.transform(ordered, lambda r: r["values"]).alias("rows"),
    ).select(*keys, "head", "parts", table_struct(F.col("headers"), F.col("rows")).cast(TABLE_TYPE).alias("table"))


def stitched_nodes(nodes: DataFrame, keys: list[str], position: str = "ord", width: int = BLOCK) -> DataFrame:
    """The node list after stitching: run heads, and other nodes.

    Parts that joined a run are gone, and so is the short text inside a run.
    """
    tables = parsed_tables(nodes, keys, position)
    heads = table_heads(tables, keys, position, "assembly", width)
    marked = nodes.join(heads, [*keys, position], "left").withColumn(
        "_table", F.when(F.col("type") == "TABLE", F.col(position).cast("long"))
    )
    behind = carry_last(marked, keys, position, {"_table": "_before"})
    joined = behind.where((F.col("type") == "TABLE") & (F.col("head") != F.col(position)))
    inside = joined.select(*keys, "_before").distinct().withColumn("_drop", F.lit(True))
    kept = behind.join(inside, [*keys, "_before"], "left").where(
        F.when(F.col("type") == "TABLE", F.col("head") == F.col(position)).otherwise(F.col("_drop").isNull())
    )
    return kept.drop("_table", "_before", "_drop", "head")
