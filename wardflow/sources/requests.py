"""Scoring requests: JSON lines {"data": [[...], ...], "columns": [...]} to typed rows."""

from pyspark.sql import functions as F

from wardflow import schema as S
from wardflow.operators.joins import symmetric_difference

ENVELOPE = "data string, columns array<string>"


def text_array_sql(names):
    return "array({})".format(", ".join(f"'{n}'" for n in names))


def text_array(names):
    return F.expr(text_array_sql(names))


def checked_requests(lines, body="value", request="request", expected=S.REQUEST_COLUMNS, keep=()):
    """Requests with their parsed cells and the reason why they are refused, null if they are not.

    Columns are bound by name, so their order does not matter. A flat list of values
    is a request with one row. Names must equal the expected ones and every row must
    have as many values; otherwise the whole request is refused. `keep` names columns of the
    lines to carry along. Where both rows and refusals are wanted, store this table first,
    so that lines are parsed once.
    """
    nested = F.from_json(F.col("_e.data"), "array<array<string>>")
    flat = F.from_json(F.col("_e.data"), "array<string>")
    is_flat = F.col("_e.data").rlike(r"^\s*\[\s*[^\[\s]")
    names = text_array(expected)
    # explode of one element: the JSON is parsed once, not again in the filters on it
    opened = lines.select(
        request, *keep, F.col(body).alias("_body"), F.explode(F.array(F.from_json(body, ENVELOPE))).alias("_e")
    ).select(
        request,
        *keep,
        "_body",
        F.col("_e.columns").alias("_names"),
        F.col("_e.data").alias("_text"),
        F.explode(F.array(F.when(is_flat, F.array(flat)).otherwise(nested))).alias("_data"),
    )
    different = symmetric_difference(names, F.col("_names"))
    width = len(expected)
    reason = (
        F.when(F.coalesce(F.trim("_body"), F.lit("")).isin("", "{}", "null", "[]"), "no JSON payload")
        .when(F.col("_text").isNull(), "'data' field is missing")
        .when(F.col("_names").isNull(), "'columns' field is missing")
        .when(F.size(different) > 0, F.concat(F.lit("extra or missing columns: "), F.array_join(different, ", ")))
        .when(
            F.col("_data").isNull() | F.exists("_data", lambda r: F.coalesce(F.size(r) != width, F.lit(True))),
            "invalid input shape",
        )
        .when(F.size("_names") != width, "invalid input shape")
    )
    return opened.withColumn("reason", reason)


def refused(checked, request="request", keep=()):
    """Refused requests with the reason."""
    return checked.filter(F.col("reason").isNotNull()).select(request, "reason", *keep)


def rows_of(checked, request="request", expected=S.REQUEST_COLUMNS, keep=()):
    """One typed row per data row of the accepted requests; `row` numbers them from 0.

    The cells of a row are cast as one array for each type. A cast for each column would make the
    generated code of a row one method of more than 8,000 bytes, which the JVM never compiles.
    """
    types = {f.name: f.dataType.simpleString() for f in S.OBSERVATIONS}
    groups = {}  # columns by type
    for c in expected:
        groups.setdefault(types[c], []).append(c)
    places = {
        f"_at_{t}": F.expr("transform({}, c -> cast(array_position(_names, c) AS int))".format(text_array_sql(members)))
        for t, members in groups.items()
    }
    typed = [f"try_cast(transform(`_at_{t}`, p -> element_at(_cells, p)) AS array<{t}>) AS `_as_{t}`" for t in groups]
    cells = (
        checked.filter(F.col("reason").isNull())
        .select(request, *keep, *[e.alias(name) for name, e in places.items()], "_data")
        .select(request, *keep, *[F.col(name) for name in places], F.posexplode("_data").alias("row", "_cells"))
        .selectExpr(f"`{request}`", "row", *[f"`{k}`" for k in keep], *typed)
    )
    values = [F.get(f"_as_{types[c]}", F.lit(groups[types[c]].index(c))).alias(c) for c in expected]
    return cells.select(request, "row", *keep, *values)


def parse_requests(lines, body="value", request="request", expected=S.REQUEST_COLUMNS, keep=()):
    """(rows, rejects) of request lines: see checked_requests, rows_of and refused."""
    checked = checked_requests(lines, body, request, expected, keep)
    return rows_of(checked, request, expected, keep), refused(checked, request)


def as_request(df, columns, request="request", row="row", rows_per_request=None):
    """JSON request lines, one for each request name, from rows with a position from 0.

    With rows_per_request, long requests become several lines and are separate requests
    from then on; cut only where the rows of a unit (a patient) need not stay together.
    """
    values = F.expr("array({})".format(", ".join(f"cast(`{c}` AS string)" for c in columns)))
    chunk = F.floor(F.col(row) / rows_per_request) if rows_per_request else F.lit(0)
    numbered = df.withColumn("chunk", chunk)
    listed = numbered.groupBy(request, "chunk").agg(
        F.array_sort(F.collect_list(F.struct(F.col(row).alias("r"), values.alias("v")))).alias("rows")
    )
    body = F.struct(F.transform("rows", lambda r: r["v"]).alias("data"), text_array(columns).alias("columns"))
    return listed.select(
        (F.concat_ws("#", request, "chunk") if rows_per_request else F.col(request)).alias(request), F.to_json(body, {"ignoreNullFields": "false"}).alias("value")
    )
