"""One query for each operator of the inventory, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import hashing, strings, temporal
from quillon.operators import agg
from quillon.operators.expr import COMPARISON, BinaryExpression, ColumnExpression, LiteralExpression, UnaryExpression, compile_expression, evaluate
from quillon.operators.frame import Frame

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

col, lit = ColumnExpression, LiteralExpression
SIGNS = dict(zip(COMPARISON, ("=", "<>", ">", ">=", "<", "<="), strict=True))
MOD64 = "18446744073709551616::uhugeint"


def op(name: str, a, b) -> BinaryExpression:
    return BinaryExpression(name, a, b)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return register


def _all_comparisons(a, b) -> list:
    return [compile_expression(op(name, a, b)).alias(name) for name in COMPARISON]


def _all_sql(a: str, b: str) -> str:
    return ", ".join(f"{a} {sign} {b} AS {name}" for name, sign in SIGNS.items())


@query(f"SELECT event_id, {_all_sql('user_id', '8')} FROM events")
def cmp_scalar_i64(spark, d):
    return table(spark, d, "events").select("event_id", *_all_comparisons(col("user_id"), lit(8)))


@query(f"SELECT event_id, {_all_sql('value', '5.0')} FROM events")
def cmp_scalar_f64(spark, d):
    return table(spark, d, "events").select("event_id", *_all_comparisons(col("value"), lit(5.0)))


@query(f"SELECT p_partkey, {_all_sql('p_size', '10')} FROM part")
def cmp_scalar_i32(spark, d):
    return table(spark, d, "part").select("p_partkey", *_all_comparisons(col("p_size"), lit(10)))


@query(f"SELECT l_orderkey, l_partkey, {_all_sql('l_orderkey', 'l_partkey')} FROM lineitem")
def cmp_vector_i64(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *_all_comparisons(col("l_orderkey"), col("l_partkey")))


@query(f"SELECT l_orderkey, l_extendedprice, {_all_sql('l_extendedprice', 'l_quantity * 1000')} FROM lineitem")
def cmp_vector_f64(spark, d):
    right = op("multiply", col("l_quantity"), lit(1000))
    return table(spark, d, "lineitem").select("l_orderkey", "l_extendedprice", *_all_comparisons(col("l_extendedprice"), right))


@query("SELECT l_orderkey, l_returnflag, l_returnflag = 'A' AS result FROM lineitem")
def cmp_string_eq(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", compile_expression(op("equals", col("l_returnflag"), lit(b"A"))).alias("result"))


@query(f"SELECT o_orderkey, {_all_sql('cast(o_orderdate AS date)', chr(100) + 'ate ' + repr('1998-01-01'))} FROM orders")
def cmp_date(spark, d):
    import datetime

    df = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return df.select("o_orderkey", *_all_comparisons(col("day"), lit(datetime.date(1998, 1, 1))))


@query(f"SELECT event_id, {_all_sql('ts', 'timestamp ' + repr('2024-01-02 00:00:00'))} FROM events")
def cmp_timestamp(spark, d):
    df = table(spark, d, "events").withColumn("bound", F.lit("2024-01-02 00:00:00").cast("timestamp_ntz"))
    return df.select("event_id", *_all_comparisons(col("ts"), col("bound")))


@query("SELECT event_id, (user_id > 50) = true AS eq, (user_id > 50) <> true AS ne FROM events")
def cmp_bool(spark, d):
    big = op("greater_than", col("user_id"), lit(50))
    return table(spark, d, "events").select("event_id", compile_expression(op("equals", big, lit(True))).alias("eq"), compile_expression(op("not_equals", big, lit(True))).alias("ne"))


@query("SELECT event_id, coalesce(nullif(user_id, 8) > 5, false) AS gt, coalesce(nullif(user_id, 8) <> 9, false) AS ne FROM events")
def cmp_zero_mode(spark, d):
    df = table(spark, d, "events").withColumn("u", F.nullif("user_id", F.lit(8)))
    return df.select("event_id", compile_expression(op("greater_than", col("u"), lit(5)), "zero").alias("gt"), compile_expression(op("not_equals", col("u"), lit(9)), "zero").alias("ne"))


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity < 10 AND l_returnflag = 'A'")
def pred_and(spark, d):
    e = op("and", op("less_than", col("l_quantity"), lit(10.0)), op("equals", col("l_returnflag"), lit("A")))
    return Frame(table(spark, d, "lineitem")).filter(e).select(["l_orderkey", "l_partkey", "l_quantity"]).df


@query("SELECT event_id, user_id FROM events WHERE user_id = 1 OR user_id = 5")
def pred_or(spark, d):
    e = op("or", op("equals", col("user_id"), lit(1)), op("equals", col("user_id"), lit(5)))
    return Frame(table(spark, d, "events")).filter(e).select(["event_id", "user_id"]).df


@query("SELECT event_id, user_id FROM events WHERE NOT (user_id = 1)")
def pred_not(spark, d):
    e = UnaryExpression("not", op("equals", col("user_id"), lit(1)))
    return Frame(table(spark, d, "events")).filter(e).select(["event_id", "user_id"]).df


@query("SELECT event_id, (value > 5) <> (user_id < 50) AS result FROM events")
def pred_xor(spark, d):
    e = op("xor", op("greater_than", col("value"), lit(5.0)), op("less_than", col("user_id"), lit(50)))
    return table(spark, d, "events").select("event_id", compile_expression(e).alias("result"))


def nested_filter(df: DataFrame) -> DataFrame:
    e = op("and", op("or", op("less_than", col("l_quantity"), lit(10.0)), op("greater_than", col("l_quantity"), lit(40.0))), op("equals", col("l_returnflag"), lit("A")))
    return Frame(df).filter(e).select(["l_orderkey", "l_partkey", "l_quantity", "l_returnflag"]).df


@query("SELECT l_orderkey, l_partkey, l_quantity, l_returnflag FROM lineitem WHERE (l_quantity < 10 OR l_quantity > 40) AND l_returnflag = 'A'")
def pred_nested(spark, d):
    return nested_filter(table(spark, d, "lineitem"))


@query("SELECT count(*) AS n, sum(CASE WHEN result THEN 1 ELSE 0 END)::bigint AS hits FROM (SELECT (l_quantity < 10 OR l_quantity > 40) AND l_returnflag = 'A' AS result FROM lineitem)")
def evaluate_mask(spark, d):
    e = op("and", op("or", op("less_than", col("l_quantity"), lit(10.0)), op("greater_than", col("l_quantity"), lit(40.0))), op("equals", col("l_returnflag"), lit("A")))
    return evaluate(table(spark, d, "lineitem"), e).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("result").cast("long")).alias("hits"))


@query("SELECT l_orderkey, l_partkey, l_extendedprice * (1 - l_discount) AS product, l_quantity + l_tax AS total, l_quantity - l_tax AS difference, l_extendedprice / l_quantity AS ratio FROM lineitem")
def arith(spark, d):
    e = {
        "product": op("multiply", col("l_extendedprice"), op("subtract", lit(1), col("l_discount"))),
        "total": op("add", col("l_quantity"), col("l_tax")),
        "difference": op("subtract", col("l_quantity"), col("l_tax")),
        "ratio": op("divide", col("l_extendedprice"), col("l_quantity")),
    }
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", *[compile_expression(x).alias(k) for k, x in e.items()])


@query("SELECT sum(user_id)::bigint AS total, min(user_id) AS low, max(user_id) AS high FROM events")
def agg_sum_min_max_i64(spark, d):
    c = F.col("user_id")
    return table(spark, d, "events").agg(agg.total(c).alias("total"), agg.minimum(c).alias("low"), agg.maximum(c).alias("high"))


@query("SELECT round(sum(value), 4) AS total, min(value) AS low, max(value) AS high FROM events")
def agg_sum_min_max_f64(spark, d):
    c = F.col("value")
    return table(spark, d, "events").agg(F.round(agg.total(c), 4).alias("total"), agg.minimum(c).alias("low"), agg.maximum(c).alias("high"))


@query("SELECT coalesce(sum(nullif(user_id, 8)), 0)::bigint AS total, min(coalesce(nullif(user_id, 8), 0)) AS low, max(coalesce(nullif(user_id, 8), 0)) AS high FROM events")
def agg_zero_mode(spark, d):
    c = F.nullif("user_id", F.lit(8))
    return table(spark, d, "events").agg(agg.total(c, "zero").alias("total"), agg.minimum(c, "zero").cast("long").alias("low"), agg.maximum(c, "zero").cast("long").alias("high"))


@query("SELECT min(cast(l_shipdate AS date)) AS low, max(cast(l_shipdate AS date)) AS high FROM lineitem")
def agg_date(spark, d):
    c = F.to_date("l_shipdate")
    return table(spark, d, "lineitem").agg(agg.minimum(c).alias("low"), agg.maximum(c).alias("high"))


@query("SELECT min(ts) AS low, max(ts) AS high FROM events")
def agg_timestamp(spark, d):
    return table(spark, d, "events").agg(agg.minimum(F.col("ts")).alias("low"), agg.maximum(F.col("ts")).alias("high"))


@query("SELECT sum(p_size)::bigint AS total, min(p_size) AS low, max(p_size) AS high FROM part")
def agg_small_types(spark, d):
    c = F.col("p_size")
    return table(spark, d, "part").agg(agg.total(c).alias("total"), agg.minimum(c).alias("low"), agg.maximum(c).alias("high"))


@query("SELECT coalesce(bool_or(l_quantity > 49), false) AS some, coalesce(bool_and(l_quantity > 0), true) AS every, coalesce(bool_and(coalesce(nullif(l_quantity, 7) > 0, false)), true) AS every_with_nulls FROM lineitem")
def agg_any_all(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").agg(agg.any_true(q > 49).alias("some"), agg.all_true(q > 0).alias("every"), agg.all_true(F.nullif(q, F.lit(7.0)) > 0).alias("every_with_nulls"))


@query("SELECT count(*) - count(nullif(l_returnflag, 'A')) AS nulls FROM lineitem")
def null_count(spark, d):
    return table(spark, d, "lineitem").agg(agg.null_count(F.nullif("l_returnflag", F.lit("A"))).alias("nulls"))


@query("SELECT event_id, cast(nullif(user_id, 8) IS NULL AS int) AS missing, nullif(user_id, 8) IS NULL AS result FROM events")
def is_null(spark, d):
    df = table(spark, d, "events").withColumn("u", F.nullif("user_id", F.lit(8)))
    return df.select("event_id", agg.is_null(F.col("u")).alias("missing"), compile_expression(UnaryExpression("is_null", col("u"))).alias("result"))


@query("SELECT o_totalprice AS price, o_orderkey AS id FROM orders")
def select_rename(spark, d):
    return Frame(table(spark, d, "orders")).select(["o_totalprice", "o_orderkey"]).rename({"o_totalprice": "price", "o_orderkey": "id", "absent": "x"}).df


#: 50 places with repeats, spread over the first thousand rows.
TAKEN = [(i * 37) % 1000 for i in range(48)] + [0, 0]


@query(f"WITH placed AS (SELECT o_orderkey, o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT o_orderkey, o_custkey FROM (SELECT unnest({TAKEN}) AS pos) JOIN placed USING (pos)")
def take_rows(spark, d):
    return Frame(table(spark, d, "orders"), "o_orderkey").select(["o_orderkey", "o_custkey"]).take(TAKEN).df


@query(f"WITH placed AS (SELECT event_id, coalesce(nullif(user_id, 8), 0) AS u, row_number() OVER (ORDER BY event_id) - 1 AS pos FROM events) SELECT event_id, u FROM (SELECT unnest({TAKEN}) AS pos) JOIN placed USING (pos)")
def take_zero_mode(spark, d):
    df = table(spark, d, "events").select("event_id", F.nullif("user_id", F.lit(8)).alias("u"))
    return Frame(df, "event_id").take(TAKEN, null_mode="zero").df


@query("SELECT o_orderkey, o_orderstatus AS status FROM orders WHERE o_totalprice > 200000")
def copy_with_mask(spark, d):
    mask = op("greater_than", col("o_totalprice"), lit(200000.0))
    return Frame(table(spark, d, "orders")).copy(["o_orderkey", "o_orderstatus"], mask=mask).rename(["o_orderkey", "status"]).df


def _mix_sql(x: str) -> str:
    return f"((xor({x}, {x} >> 33)::uhugeint * {hashing.MIX}::uhugeint) % {MOD64})"


def _signed_sql(h: str) -> str:
    return f"CASE WHEN {h} >= 9223372036854775808 THEN ({h}::hugeint - 18446744073709551616)::bigint ELSE {h}::bigint END"


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_mix_sql('user_id::ubigint')} AS h FROM events)")
def hash_i64(spark, d):
    return table(spark, d, "events").select("event_id", hashing.mix64(F.col("user_id")).alias("h"))


@query(f"SELECT event_id, CASE WHEN u IS NULL THEN {hashing.signed(hashing.NULL_HASH)} ELSE {_signed_sql('h')} END AS h FROM (SELECT event_id, u, {_mix_sql('u')} AS h FROM (SELECT event_id, nullif(user_id, 8)::ubigint AS u FROM events))")
def hash_null(spark, d):
    return table(spark, d, "events").select("event_id", hashing.mix64(F.nullif("user_id", F.lit(8))).alias("h"))


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_mix_sql('u')} AS h FROM (SELECT event_id, epoch_us(ts)::ubigint AS u FROM events))")
def hash_timestamp(spark, d):
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, d, "events").select("event_id", hashing.mix64(micros).alias("h"))


@query(f"SELECT o_orderkey, {_signed_sql('h')} AS h FROM (SELECT o_orderkey, {_mix_sql('u')} AS h FROM (SELECT o_orderkey, date_diff('day', date '1970-01-01', cast(o_orderdate AS date))::ubigint AS u FROM orders))")
def hash_date(spark, d):
    return table(spark, d, "orders").select("o_orderkey", hashing.mix64(temporal.epoch_days(F.to_date("o_orderdate"))).alias("h"))


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_mix_sql('(user_id > 50)::int::ubigint')} AS h FROM events)")
def hash_bool(spark, d):
    return table(spark, d, "events").select("event_id", hashing.mix64((F.col("user_id") > 50).cast("int")).alias("h"))


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_mix_sql('b')} AS h FROM (SELECT event_id, value::double::bit::ubigint AS b FROM events))")
def hash_f64(spark, d):
    return table(spark, d, "events").select("event_id", hashing.float_hash(F.col("value")).alias("h"))


_FNV_SQL = f"list_reduce(list_prepend({hashing.FNV_OFFSET}::uhugeint, [('0x' || hex(encode(s))[2 * i - 1 : 2 * i])::int::uhugeint FOR i IN range(1, strlen(s) + 1)]), lambda h, b: (xor(h, b) * {hashing.FNV_PRIME}::uhugeint) % {MOD64})"


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_FNV_SQL} AS h FROM (SELECT event_id, event_type AS s FROM events))")
def hash_string(spark, d):
    return table(spark, d, "events").select("event_id", hashing.fnv1a64(F.col("event_type")).alias("h"))


@query("SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS upper_text FROM documents")
def ascii_upper(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.ascii_upper(F.col("text")).alias("upper_text"))


@query("SELECT doc_id, strlen(text)::int AS n_bytes, coalesce(strlen(nullif(lang, 'en')), 0)::int AS lang_bytes FROM documents")
def byte_length(spark, d):
    return table(spark, d, "documents").select("doc_id", strings.byte_length(F.col("text")).alias("n_bytes"), strings.byte_length(F.nullif("lang", F.lit("en")), "zero").alias("lang_bytes"))


@query("SELECT sum(strlen(text))::bigint AS n_bytes FROM documents")
def total_byte_length(spark, d):
    return table(spark, d, "documents").agg(F.sum(strings.byte_length(F.col("text")).cast("long")).alias("n_bytes"))


@query("SELECT doc_id, sum(strlen(text)) OVER (ORDER BY doc_id)::bigint AS end_offset FROM documents")
def string_offsets(spark, d):
    return strings.offsets(table(spark, d, "documents"), "text", "doc_id")


@query("""SELECT event_id, '{"id": ' || event_id || ',"t": ' || coalesce('"' || nullif(event_type, 'click') || '"', 'null') || '}' AS json FROM events""")
def struct_json(spark, d):
    fields = {"id": F.col("event_id"), "t": F.nullif("event_type", F.lit("click"))}
    return table(spark, d, "events").select("event_id", strings.struct_json(fields, {"t"}).alias("json"))


@query("SELECT event_id, (hour(ts) * 3600 + minute(ts) * 60) * 1000000 + microsecond(ts) AS micros FROM events")
def time_micros(spark, d):
    return table(spark, d, "events").select("event_id", temporal.time_micros(F.col("ts")).alias("micros"))


@query("SELECT vec_id, len(embedding)::int AS n, embedding[1]::double AS first, embedding IS NULL AS missing FROM embeddings")
def array_basic(spark, d):
    e = F.col("embedding")
    return table(spark, d, "embeddings").select("vec_id", F.size(e).alias("n"), F.element_at(e, 1).cast("double").alias("first"), e.isNull().alias("missing"))


@query("SELECT count(*) AS n_rows, 11 AS n_columns FROM lineitem")
def frame_shape(spark, d):
    df = table(spark, d, "lineitem")
    return df.agg(F.count(F.lit(1)).alias("n_rows")).withColumn("n_columns", F.lit(Frame(df).num_columns))


@query(f"SELECT event_id, {_signed_sql('h')} AS h FROM (SELECT event_id, {_mix_sql('u')} AS h FROM (SELECT event_id, ((hour(ts) * 3600 + minute(ts) * 60) * 1000000 + microsecond(ts))::ubigint AS u FROM events))")
def hash_time(spark, d):
    return table(spark, d, "events").select("event_id", hashing.mix64(temporal.time_micros(F.col("ts"))).alias("h"))


_ARRAY_SQL = f"list_reduce(list_prepend({hashing.FNV_OFFSET}::uhugeint, [CASE WHEN x IS NULL THEN {hashing.NULL_HASH}::uhugeint ELSE {_mix_sql('x::ubigint')} END FOR x IN xs]), lambda h, e: (xor(h, e) * {hashing.FNV_PRIME}::uhugeint) % {MOD64})"


@query(f"SELECT event_id, CASE WHEN xs IS NULL THEN 0 ELSE {_signed_sql('h')} END AS h FROM (SELECT event_id, xs, {_ARRAY_SQL} AS h FROM (SELECT event_id, CASE WHEN user_id <> 8 THEN [event_id, nullif(user_id, 9), 7] END AS xs FROM events))")
def hash_array(spark, d):
    xs = F.when(F.col("user_id") != 8, F.array(F.col("event_id").cast("long"), F.nullif(F.col("user_id").cast("long"), F.lit(9)), F.lit(7).cast("long")))
    return table(spark, d, "events").select("event_id", hashing.array_hash(xs).alias("h"))


@query(f"SELECT p_partkey, CASE WHEN s IS NULL THEN 0 ELSE {_signed_sql('h')} END AS h FROM (SELECT p_partkey, s, {_FNV_SQL} AS h FROM (SELECT p_partkey, nullif(p_size, 8)::decimal(12, 2)::varchar AS s FROM part))")
def hash_fallback(spark, d):
    return table(spark, d, "part").select("p_partkey", hashing.fallback_hash(F.nullif("p_size", F.lit(8)).cast("decimal(12,2)")).alias("h"))


@query(f"SELECT item_id, {_signed_sql('h')} AS h FROM (SELECT item_id, {_FNV_SQL} AS h FROM (SELECT item_id, text AS s FROM benchmark))")
def hash_text(spark, d):
    return table(spark, d, "benchmark").select("item_id", hashing.fnv1a64_text(F.col("text")).alias("h"))


@query("SELECT 0::bigint AS entry UNION ALL SELECT sum(strlen(text)) OVER (ORDER BY doc_id)::bigint FROM documents")
def string_offset_entries(spark, d):
    return strings.offset_entries(table(spark, d, "documents"), "text", "doc_id", "entry")


@query("""SELECT event_id, CASE WHEN user_id <> 8 THEN '{"id": ' || event_id || ',"t": "' || event_type || '","big": ' || CASE WHEN user_id > 50 THEN 'True' ELSE 'False' END || ',"xs": [' || user_id || ', ' || CASE WHEN user_id = 9 THEN 'None' ELSE '7' END || ']}' END AS json FROM events""")
def struct_json_typed(spark, d):
    big, xs = (F.col("user_id") > 50).alias("big"), F.array("user_id", F.when(F.col("user_id") != 9, F.lit(7))).alias("xs")
    s = F.when(F.col("user_id") != 8, F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("t"), big, xs))
    df = table(spark, d, "events").select("event_id", s.alias("s"))
    return df.select("event_id", strings.struct_column_json(df, "s").alias("json"))


@query(f"WITH placed AS (SELECT vec_id, CASE WHEN vec_id % 3 <> 0 THEN embedding END AS e, row_number() OVER (ORDER BY vec_id) - 1 AS pos FROM embeddings) SELECT vec_id, len(e)::int AS n, e[2]::double AS second, (SELECT count(*) FROM placed WHERE e IS NULL) AS nulls FROM (SELECT unnest({[i % 200 for i in TAKEN]}) AS pos) JOIN placed USING (pos)")
def array_take(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("e"))
    nulls = df.agg(agg.null_count(F.col("e")).alias("nulls"))
    taken = Frame(df, "vec_id").take([i % 200 for i in TAKEN]).df
    return taken.crossJoin(F.broadcast(nulls)).select("vec_id", F.when(F.col("e").isNotNull(), F.size("e")).alias("n"), F.get("e", F.lit(1)).cast("double").alias("second"), "nulls")  # nulls is one row


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', '{o}', {str(v).lower()})" for a, b, o, v in (("bigint", "bigint", "add", True), ("bigint", "double", "add", False), ("string", "string", "equals", True), ("string", "string", "add", False), ("boolean", "boolean", "xor", True), ("bigint", "bigint", "and", False), ("date", "date", "less_than", True))) + ") AS t(l, r, operation, supported)")
def supported_operations(spark, d):
    from pyspark.sql import types as T

    from quillon.operators.expr import is_supported

    kinds = {"bigint": T.LongType(), "double": T.DoubleType(), "string": T.StringType(), "boolean": T.BooleanType(), "date": T.DateType()}
    asked = [("bigint", "bigint", "add"), ("bigint", "double", "add"), ("string", "string", "equals"), ("string", "string", "add"), ("boolean", "boolean", "xor"), ("bigint", "bigint", "and"), ("date", "date", "less_than")]
    return spark.createDataFrame([(a, b, o, is_supported(kinds[a], kinds[b], o)) for a, b, o in asked], "l string, r string, operation string, supported boolean")


@query("SELECT * FROM (VALUES ('n_nationkey', 4), ('n_name', 60), ('n_regionkey', 4)) AS t(name, code)")
def frame_types(spark, d):
    frame = Frame(table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name", F.col("n_regionkey").cast("long").alias("n_regionkey")))
    return spark.createDataFrame(list(zip([n.decode() for n in frame.column_names], frame.column_types, strict=True)), "name string, code int")


@query("SELECT n_nationkey, n_name FROM nation")
def arrow_round_trip(spark, d):
    from quillon.sources import from_arrow

    return from_arrow(spark, Frame(table(spark, d, "nation")).select(["n_nationkey", "n_name"]).to_arrow()).df


@query("WITH placed AS (SELECT o_orderkey, o_orderstatus, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders) SELECT pos AS place, o_orderkey, o_orderstatus AS status FROM placed WHERE pos IN (0, 7, 99)")
def frame_elements(spark, d):
    frame = Frame(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), "o_orderkey")
    rows = [(i, frame[i][0], frame.element("o_orderstatus", i).decode()) for i in (0, 7, 99)]
    return spark.createDataFrame(rows, "place long, o_orderkey long, status string")
