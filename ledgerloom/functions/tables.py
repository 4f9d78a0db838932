"""Table content: from any notation to ``struct<headers, rows>`` and back.

The canonical form is ``struct<headers: array<string>, rows:
array<array<string>>>``.  Everything is a built-in expression over one cell,
so a scan over nodes parses its tables without a shuffle and without Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .hof import BLANKS, any_pattern, let, map_last_wins, strip  # noqa: F401

TABLE_TYPE = "struct<headers:array<string>,rows:array<array<string>>>"
_MARKER = r"<fcel>|<nl>|<ecel>|<lcel>|<ucel>"
_CELL = r"<fcel>|<lcel>|<ucel>"


def table_struct(headers: Column, rows: Column) -> Column:
    return F.struct(headers.alias("headers"), rows.alias("rows")).cast(TABLE_TYPE)


def empty_table() -> Column:
    return table_struct(F.array().cast("array<string>"), F.array().cast("array<array<string>>"))


def fit_row(row: Column, width: Column) -> Column:
    """Pad with blanks or cut to the header width."""
    return F.slice(F.concat(row, F.array_repeat(F.lit(""), width)), F.lit(1), width)


def fit_rows(headers: Column, rows: Column) -> Column:
    return F.transform(rows, lambda r: fit_row(r, F.size(headers)))


def blank_nulls(row: Column) -> Column:
    return F.transform(row, lambda c: F.coalesce(c, F.lit("")))


def is_otsl(text: Column) -> Column:
    return text.rlike(_MARKER)


def parse_otsl(text: Column) -> Column:
    """Markup whose cells start with ``<fcel>`` and whose rows end with ``<nl>``."""

    def cells(row: Column) -> Column:
        parts = F.split(row, _CELL)
        parts = F.filter(parts, lambda c: (c == "") | (strip(c) != ""))
        parts = F.when((F.size(parts) > 1) & (parts[0] == ""), F.slice(parts, F.lit(2), F.size(parts))).otherwise(parts)
        plain = lambda c: F.replace(F.regexp_replace(strip(c), r"\\+\(", "("), F.lit("\\)"), F.lit(")"))
        return F.transform(parts, plain)

    body = F.replace(strip(text), F.lit("<ecel>"), F.lit(""))
    lines = F.filter(F.split(body, "<nl>"), lambda r: strip(r) != "")
    grid = F.filter(F.transform(lines, cells), lambda r: F.size(r) > 0)
    return let(
        grid,
        lambda g: F.when(
            F.size(g) > 0,
            table_struct(g[0], fit_rows(g[0], F.slice(g, F.lit(2), F.size(g)))),
        ).otherwise(empty_table()),
    )


def _pipe_cells(line: Column) -> Column:
    """Cells of one pipe row; a blank cell at either end is the border."""
    inner = F.regexp_replace(F.regexp_replace(line, r"(?U)^\s*\|", ""), r"(?U)\|\s*$", "")
    return F.transform(F.split(inner, r"\|"), strip)


def content_lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(strip(text), "\n"), strip), lambda l: l != "")


def parse_markdown(text: Column) -> Column:
    """First pipe row followed by a rule, else first row with two pipes; null if none."""

    def table(lines: Column) -> Column:
        index = F.transform(lines, lambda l, i: F.struct(l.alias("line"), i.alias("i")))
        ruled = F.filter(
            index,
            lambda x: x["line"].contains("|") & F.coalesce(F.get(lines, x["i"] + 1).contains("---"), F.lit(False)),
        )
        plain = F.filter(index, lambda x: F.size(F.split(x["line"], r"\|")) > 2)
        at = F.coalesce(F.get(ruled, F.lit(0))["i"], F.get(plain, F.lit(0))["i"])
        skip = F.when(F.get(lines, at + 1).contains("---"), 3).otherwise(2)
        headers = _pipe_cells(F.get(lines, at))
        data = F.filter(F.slice(lines, at + skip, F.size(lines)), lambda l: l.contains("|"))
        return F.when(
            at.isNotNull(), table_struct(headers, fit_rows(headers, F.transform(data, _pipe_cells)))
        )

    return let(content_lines(text), table)


def columnar_to_table(columns: Column) -> Column:
    """``map<string,array<string>>`` to rows; short columns are padded."""

    def table(m: Column) -> Column:
        headers, cells = F.map_keys(m), F.map_values(m)
        depth = F.coalesce(F.array_max(F.transform(cells, F.size)), F.lit(0))
        index = F.when(depth > 0, F.sequence(F.lit(0), depth - 1)).otherwise(F.array().cast("array<int>"))
        rows = F.transform(
            index, lambda i: F.transform(cells, lambda c: F.coalesce(F.get(c, i), F.lit("")))
        )
        return table_struct(headers, rows)

    return let(columns, table)


def table_to_columnar(table: Column) -> Column:
    """Rows to ``map<string,array<string>>``; a repeated header keeps its last column."""
    entries = F.transform(
        table["headers"],
        lambda h, i: F.struct(
            h.alias("key"),
            F.transform(table["rows"], lambda r: F.coalesce(F.get(r, i), F.lit(""))).alias("value"),
        ),
    )
    return map_last_wins(entries)


def parse_json_table(text: Column) -> Column:
    """``{headers, rows}`` or ``{header: [cells]}``; null for anything else."""
    as_rows = let(
        F.from_json(text, "struct<headers:array<string>,rows:array<array<string>>>"),
        lambda rows: F.when(
            rows["headers"].isNotNull() & rows["rows"].isNotNull(),
            table_struct(blank_nulls(rows["headers"]), F.transform(rows["rows"], blank_nulls)),
        ),
    )
    as_columns = let(
        F.from_json(text, "map<string,array<string>>"),
        lambda columns: F.when(
            (F.size(columns) > 0) & F.forall(F.map_values(columns), lambda v: v.isNotNull()),
            columnar_to_table(columns),
        ),
    )
    return F.coalesce(as_rows, as_columns)


def _otsl_in_json(text: Column) -> Column:
    """Markup that was split into keys and values of a JSON object, joined again."""
    entries = F.map_entries(F.from_json(text, "map<string,string>"))
    joined = F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.coalesce(e["value"], F.lit("")))), "")
    return F.when(is_otsl(joined), parse_otsl(joined))


def looks_json(text: Column) -> Column:
    return text.rlike(r"(?U)^\s*[{\[]")


def normalize_table(text: Column) -> Column:
    """Any notation to the canonical form.

    JSON first, then markup, then a pipe table; text that is none of these
    becomes one cell under the header ``content``; blank text an empty table.
    """
    blob = table_struct(F.array(F.lit("content")), F.array(F.array(strip(text))))
    from_json = F.when(looks_json(text), F.coalesce(parse_json_table(text), _otsl_in_json(text)))
    from_otsl = F.when(is_otsl(text), parse_otsl(text))
    from_pipes = F.when(text.contains("|"), parse_markdown(text))
    return F.when(
        text.isNotNull() & (strip(text) != ""), F.coalesce(from_json, from_otsl, from_pipes, blob)
    ).otherwise(empty_table())


def table_notation(text: Column) -> Column:
    """Which branch of ``normalize_table`` a text takes."""
    return (
        F.when(text.isNull() | (strip(text) == ""), "empty")
        .when(looks_json(text) & parse_json_table(text).isNotNull(), "json")
        .when(is_otsl(text), "otsl")
        .when(text.contains("|") & parse_markdown(text).isNotNull(), "markdown")
        .otherwise("blob")
    )


def notation_and_table(text: Column) -> Column:
    """``struct<notation, table>``: ``table_notation`` and ``normalize_table``, each text parsed once."""

    def read(notation: Column, table: Column) -> Column:
        return F.struct(notation.alias("notation"), table.alias("table"))

    def other(t: Column) -> Column:
        """Text that is no JSON table."""
        in_json = F.when(looks_json(t), _otsl_in_json(t))
        blob = table_struct(F.array(F.lit("content")), F.array(F.array(strip(t))))
        otsl = F.when(is_otsl(t), read(F.lit("otsl"), F.coalesce(in_json, parse_otsl(t))))
        pipes = let(
            F.when(t.contains("|"), parse_markdown(t)),
            lambda p: read(F.when(p.isNotNull(), "markdown").otherwise("blob"), F.coalesce(in_json, p, blob)),
        )
        return F.coalesce(otsl, pipes)

    def filled(t: Column) -> Column:
        return let(
            F.when(looks_json(t), parse_json_table(t)),
            lambda j: F.when(j.isNotNull(), read(F.lit("json"), j)).otherwise(other(t)),
        )

    return let(text, lambda t: F.when(t.rlike(f"[^{BLANKS}]"), filled(t)).otherwise(read(F.lit("empty"), empty_table())))


def key_value_lines(text: Column) -> Column:
    """``key: value`` and ``key = value`` lines as a map; the last of a key wins."""

    def entry(line: Column) -> Column:
        colon_key = F.substring_index(line, ":", 1)
        colon = line.contains(": ") | (line.contains(":") & ~colon_key.contains("="))
        equal_key = strip(F.substring_index(line, "=", 1))
        equal = (
            line.rlike("^[^=]*=[^=]*$")
            & (F.length(line) < 200)
            & (equal_key != "")
            & ~F.substring(equal_key, 1, 3).rlike(r"(?U)\d")
        )
        pair = lambda key, sep: F.struct(
            strip(key).alias("key"),
            strip(F.substr(line, F.instr(line, sep) + F.lit(1))).alias("value"),
        )
        return F.when(colon, pair(colon_key, ":")).when(equal, pair(equal_key, "="))

    entries = F.filter(F.transform(content_lines(text), entry), lambda e: e.isNotNull())
    none = F.create_map().cast("map<string,string>")
    return F.when(text.isNull() | is_otsl(text), none).otherwise(map_last_wins(entries))


def looks_key_value(text: Column) -> Column:
    """At least half the lines look like ``key: value``."""

    def judged(lines: Column) -> Column:
        kv = F.filter(
            lines, lambda l: l.contains(": ") | (l.rlike("^[^:]*:[^:]*$") & ~l.contains("="))
        )
        single = (F.size(lines) == 1) & (lines[0].contains("=") | (F.length(lines[0]) > 200))
        enough = F.size(kv) >= F.greatest(F.lit(1), F.floor(F.size(lines) / 2))
        return F.when(F.size(lines) == 0, False).otherwise(~single & enough)

    return ~is_otsl(text) & let(content_lines(text), judged)


def to_markdown(table: Column) -> Column:
    """Pipe table; pipes in cells are escaped and line breaks become blanks."""
    cell = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    rule = F.concat(
        F.lit("|"), F.array_join(F.transform(table["headers"], lambda _: F.lit("---")), "|"), F.lit("|")
    )
    body = F.transform(table["rows"], lambda r: line(F.transform(r, cell)))
    text = F.array_join(F.concat(F.array(line(table["headers"]), rule), body), "\n")
    return F.when(F.size(table["headers"]) > 0, text).otherwise("")


def to_json(table: Column) -> Column:
    return F.to_json(table)


def header_key(header: Column) -> Column:
    """Lower case, blanks collapsed."""
    return F.lower(F.regexp_replace(strip(header), r"(?U)\s+", " "))


def header_keys(headers: Column) -> Column:
    return F.array_distinct(F.transform(headers, header_key))


def headers_compatible(a: Column, b: Column) -> Column:
    """Equal header sets, or an overlap of at least two and 80 % of the smaller."""
    smaller = F.least(F.size(a), F.size(b))
    needed = F.greatest(F.lit(2), F.floor(smaller * 0.8))
    overlap = F.size(F.array_intersect(a, b))
    same = (F.size(a) == F.size(b)) & (overlap == F.size(a))
    return (F.size(a) > 0) & (F.size(b) > 0) & (same | (overlap >= needed))


def merge_tables(first: Column, second: Column) -> Column:
    """Rows of the second table under the header of the first.

    A second table without header is dropped, a first one without header is
    replaced; a repeated header row goes; other widths are padded or cut.
    """
    h1, h2 = first["headers"], second["headers"]
    repeat = F.coalesce(
        F.transform(F.get(second["rows"], F.lit(0)), strip) == F.transform(h1, strip), F.lit(False)
    )
    tail = (
        F.when(h1 == h2, second["rows"])
        .when(repeat, F.slice(second["rows"], F.lit(2), F.size(second["rows"])))
        .otherwise(fit_rows(h1, second["rows"]))
    )
    return (
        F.when((F.size(h1) == 0) & (F.size(h2) > 0), second)
        .when(F.size(h2) == 0, first)
        .otherwise(table_struct(h1, F.concat(first["rows"], tail)))
    )


_ISSUE = "struct<rule_id:string,severity:string,message:string>"
STRUCTURE_TYPE = (
    f"struct<ok:boolean,issues:array<{_ISSUE}>,row_count:int,col_count:int,"
    "ragged_rows:int,empty_cell_ratio:double>"
)


def _issue(rule: str, severity, message) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    return F.struct(
        F.lit(rule).alias("rule_id"), as_col(severity).alias("severity"), as_col(message).alias("message")
    )


def structure_report(text: Column) -> Column:
    """Structure check of table JSON text: hard and soft issues and statistics."""

    def fatal(rule: str, message: str) -> Column:
        return F.struct(
            F.lit(False).alias("ok"),
            F.array(_issue(rule, "hard", message)).alias("issues"),
            F.lit(0).alias("row_count"),
            F.lit(0).alias("col_count"),
            F.lit(0).alias("ragged_rows"),
            F.lit(0.0).alias("empty_cell_ratio"),
        ).cast(STRUCTURE_TYPE)

    def judged(t: Column) -> Column:
        headers = F.transform(t["headers"], lambda h: strip(F.coalesce(h, F.lit("None"))))
        width = F.size(headers)
        lists = F.filter(t["rows"], lambda r: r.startswith("["))
        grid = F.transform(lists, lambda r: F.from_json(r, "array<string>"))
        row_count = F.size(t["rows"])
        ragged = F.size(F.filter(grid, lambda r: (width > 0) & (F.size(r) != width)))
        cells = F.flatten(grid)
        empty = F.size(F.filter(cells, lambda c: c.isNull() | (strip(c) == "")))
        total = F.size(cells)
        ratio = F.when(total > 0, empty / total).otherwise(0.0)
        blank = F.size(F.filter(headers, lambda h: h == ""))
        lowered = F.transform(headers, F.lower)
        repeated = F.filter(
            headers,
            lambda h, i: (h != "") & F.array_contains(F.slice(lowered, F.lit(1), i), F.lower(h)),
        )
        none = F.array().cast(f"array<{_ISSUE}>")
        one = lambda cond, issue: F.when(cond, F.array(issue)).otherwise(none)
        issues = F.concat(
            one(width == 0, _issue("table.no_headers", "hard", "no header columns")),
            one(row_count == 0, _issue("table.no_rows", "soft", "header without data rows")),
            F.transform(
                repeated,
                lambda h: _issue("table.duplicate_header", "soft", F.concat(F.lit("repeated header "), h)),
            ),
            one(blank > 0, _issue("table.blank_headers", "soft", F.concat(blank.cast("string"), F.lit(" blank header cells")))),
            F.transform(
                F.filter(t["rows"], lambda r: ~r.startswith("[")),
                lambda r: _issue("table.row_not_list", "hard", F.concat(F.lit("row is not a list: "), r)),
            ),
            one(
                ragged > 0,
                _issue(
                    "table.ragged_rows",
                    F.when(ragged > F.greatest(F.lit(1), F.floor(row_count / 5)), "hard").otherwise("soft"),
                    F.concat(ragged.cast("string"), F.lit(" rows differ from the header width "), width.cast("string")),
                ),
            ),
            one((ratio > 0.6) & (total >= 8), _issue("table.sparse", "soft", "most cells are empty")),
            one(
                (width == 1) & (headers[0] == "content") & (row_count == 1),
                _issue("table.fallback_blob", "soft", "no table structure was recognised"),
            ),
        )
        return let(
            issues,
            lambda found: F.struct(
                (~F.exists(found, lambda i: i["severity"] == "hard")).alias("ok"),
                found.alias("issues"),
                row_count.alias("row_count"),
                width.alias("col_count"),
                ragged.alias("ragged_rows"),
                ratio.alias("empty_cell_ratio"),
            ).cast(STRUCTURE_TYPE),
        )

    parsed = F.from_json(text, "struct<headers:array<string>,rows:array<string>>")
    return (
        F.when(text.isNull() | (strip(text) == ""), fatal("table.empty", "no table content"))
        .when(F.try_parse_json(text).isNull(), fatal("table.not_json", "table content is not JSON"))
        .when(
            parsed["headers"].isNull() | parsed["rows"].isNull(),
            fatal("table.schema", "headers or rows array is missing"),
        )
        .otherwise(let(parsed, judged))
    )
