"""Scalar, array, map, JSON, date and generator functions, each family as one query over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltflow.registry import query
from siltflow.tables import load


def _family(name: str, table: str, key: str, exprs: dict, where: str | None = None):
    """A query of key and named (Spark column, SQL text) expressions over one table."""
    sql = ", ".join(f"{s} AS {k}" for k, (_, s) in exprs.items())

    @query(name, f"SELECT {key}, {sql} FROM {table}" + (f" WHERE {where}" if where else ""))
    def run(spark, sf_dir):
        df = load(spark, sf_dir, table)
        return (df.where(where) if where else df).select(key, *[c().alias(k) for k, (c, _) in exprs.items()])


c = F.col
_family("fn_string", "part", "p_partkey", {
    "up": (lambda: F.upper("p_name"), "upper(p_name)"),
    "low": (lambda: F.lower("p_type"), "lower(p_type)"),
    "len": (lambda: F.length("p_name"), "CAST(length(p_name) AS INTEGER)"),
    "sub": (lambda: F.substring("p_name", 2, 4), "substring(p_name, 2, 4)"),
    "lp": (lambda: F.lpad(c("p_size").cast("string"), 5, "0"), "lpad(CAST(p_size AS VARCHAR), 5, '0')"),
    "rp": (lambda: F.rpad("p_brand", 12, "*"), "rpad(p_brand, 12, '*')"),
    "cat": (lambda: F.concat_ws("-", "p_brand", "p_type"), "concat_ws('-', p_brand, p_type)"),
    "rev": (lambda: F.reverse("p_brand"), "reverse(p_brand)"),
    "rep": (lambda: F.repeat("p_brand", 2), "repeat(p_brand, 2)"),
    "tr": (lambda: F.translate("p_brand", "Brand", "12345"), "translate(p_brand, 'Brand', '12345')"),
    "ins": (lambda: F.instr("p_brand", "a"), "CAST(instr(p_brand, 'a') AS INTEGER)"),
    "asc": (lambda: F.ascii("p_brand"), "CAST(ascii(p_brand) AS INTEGER)"),
    "lev": (lambda: F.levenshtein("p_brand", F.lit("Brand#11")), "CAST(levenshtein(p_brand, 'Brand#11') AS INTEGER)"),
    "starts": (lambda: c("p_type").startswith("PROMO"), "starts_with(p_type, 'PROMO')"),
    "has": (lambda: c("p_type").contains("STEEL"), "contains(p_type, 'STEEL')"),
    "lk": (lambda: c("p_type").like("%BRASS"), "p_type LIKE '%BRASS'"),
    "trm": (lambda: F.trim(F.concat(F.lit("  "), "p_brand", F.lit(" "))), "trim('  ' || p_brand || ' ')"),
    "lt": (lambda: F.ltrim(F.concat(F.lit("  "), "p_brand")), "ltrim('  ' || p_brand)"),
    "rpl": (lambda: F.replace("p_brand", F.lit("#"), F.lit("_")), "replace(p_brand, '#', '_')"),
    "b64": (lambda: F.base64(F.encode("p_brand", "UTF-8")), "base64(encode(p_brand))"),
    "hx": (lambda: F.hex(F.encode("p_brand", "UTF-8")), "hex(encode(p_brand))"),
    "part2": (lambda: F.split_part("p_brand", F.lit("#"), F.lit(2)), "split_part(p_brand, '#', 2)"),
})
_family("fn_regex", "part", "p_partkey", {
    "num": (lambda: F.regexp_extract("p_brand", r"(\d+)", 1), r"regexp_extract(p_brand, '(\d+)', 1)"),
    "rep": (lambda: F.regexp_replace("p_name", "[aeiou]", "."), "regexp_replace(p_name, '[aeiou]', '.', 'g')"),
    "is": (lambda: c("p_type").rlike("^(PROMO|SMALL)"), "regexp_matches(p_type, '^(PROMO|SMALL)')"),
    "cnt": (lambda: F.regexp_count("p_name", F.lit("a")).cast("int"), "CAST(len(regexp_extract_all(p_name, 'a')) AS INTEGER)"),
    "parts": (lambda: F.array_join(F.split("p_type", " "), "|"), "array_to_string(string_split(p_type, ' '), '|')"),
})
_family("fn_math", "lineitem", "l_orderkey, l_linenumber".split(", ")[0], {
    "n": (lambda: c("l_linenumber"), "l_linenumber"),
    "rt": (lambda: F.round(F.sqrt("l_quantity"), 6), "round(sqrt(l_quantity), 6)"),
    "cb": (lambda: F.round(F.cbrt("l_quantity"), 6), "round(cbrt(l_quantity), 6)"),
    "ex": (lambda: F.round(F.exp(c("l_discount")), 6), "round(exp(l_discount), 6)"),
    "ln": (lambda: F.round(F.ln("l_quantity"), 6), "round(ln(l_quantity), 6)"),
    "l2": (lambda: F.round(F.log2("l_quantity"), 6), "round(log2(l_quantity), 6)"),
    "l10": (lambda: F.round(F.log10("l_quantity"), 6), "round(log10(l_quantity), 6)"),
    "pw": (lambda: F.round(F.pow("l_discount", F.lit(2)), 8), "round(pow(l_discount, 2), 8)"),
    "fl": (lambda: F.floor("l_extendedprice"), "CAST(floor(l_extendedprice) AS BIGINT)"),
    "ce": (lambda: F.ceil("l_extendedprice"), "CAST(ceil(l_extendedprice) AS BIGINT)"),
    "sg": (lambda: F.signum(c("l_quantity") - 25), "CAST(sign(l_quantity - 25) AS DOUBLE)"),
    "ab": (lambda: F.abs(c("l_quantity") - 25), "abs(l_quantity - 25)"),
    "sn": (lambda: F.round(F.sin("l_quantity"), 6), "round(sin(l_quantity), 6)"),
    "at2": (lambda: F.round(F.atan2("l_quantity", "l_tax"), 6), "round(atan2(l_quantity, l_tax), 6)"),
    "dg": (lambda: F.round(F.degrees("l_discount"), 6), "round(degrees(l_discount), 6)"),
    "rd": (lambda: F.round(F.radians("l_quantity"), 6), "round(radians(l_quantity), 6)"),
    "md": (lambda: c("l_linenumber") % 3, "l_linenumber % 3"),
    "gr": (lambda: F.greatest("l_discount", "l_tax"), "greatest(l_discount, l_tax)"),
    "le": (lambda: F.least("l_discount", "l_tax"), "least(l_discount, l_tax)"),
    "fac": (lambda: F.factorial("l_linenumber"), "CAST(factorial(l_linenumber) AS BIGINT)"),
})
_family("fn_bit", "orders", "o_orderkey", {
    "a": (lambda: c("o_orderkey").bitwiseAND(c("o_custkey")), "o_orderkey & o_custkey"),
    "o": (lambda: c("o_orderkey").bitwiseOR(c("o_custkey")), "o_orderkey | o_custkey"),
    "x": (lambda: c("o_orderkey").bitwiseXOR(c("o_custkey")), "xor(o_orderkey, o_custkey)"),
    "nt": (lambda: F.bitwise_not(c("o_orderkey")), "~o_orderkey"),
    "sl": (lambda: F.shiftleft("o_custkey", 3), "o_custkey << 3"),
    "sr": (lambda: F.shiftright("o_custkey", 2), "o_custkey >> 2"),
    "bc": (lambda: F.bit_count("o_orderkey"), "CAST(bit_count(o_orderkey) AS INTEGER)"),
    "bn": (lambda: F.bin("o_custkey"), "bin(o_custkey)"),
    "hx": (lambda: F.hex("o_custkey"), "hex(o_custkey)"),
})
_family("fn_hash_md5", "customer", "c_custkey", {
    "m": (lambda: F.md5(c("c_name").cast("binary")), "md5(c_name)"),
    "s1": (lambda: F.sha1(c("c_name").cast("binary")), "sha1(c_name)"),
    "s2": (lambda: F.sha2(c("c_name").cast("binary"), 256), "sha256(c_name)"),
})
_family("fn_date", "orders", "o_orderkey", {
    "y": (lambda: F.year("o_orderdate"), "CAST(year(o_orderdate) AS INTEGER)"),
    "q": (lambda: F.quarter("o_orderdate"), "CAST(quarter(o_orderdate) AS INTEGER)"),
    "m": (lambda: F.month("o_orderdate"), "CAST(month(o_orderdate) AS INTEGER)"),
    "d": (lambda: F.dayofmonth("o_orderdate"), "CAST(day(o_orderdate) AS INTEGER)"),
    "dw": (lambda: F.dayofweek("o_orderdate"), "CAST(dayofweek(o_orderdate) + 1 AS INTEGER)"),
    "dy": (lambda: F.dayofyear("o_orderdate"), "CAST(dayofyear(o_orderdate) AS INTEGER)"),
    "wk": (lambda: F.weekofyear("o_orderdate"), "CAST(weekofyear(o_orderdate) AS INTEGER)"),
    "plus": (lambda: F.date_add("o_orderdate", 30), "CAST(o_orderdate AS DATE) + 30"),
    "minus": (lambda: F.date_sub("o_orderdate", 7), "CAST(o_orderdate AS DATE) - 7"),
    "diff": (lambda: F.datediff("o_orderdate", F.lit("1995-01-01").cast("date")), "CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INTEGER)"),
    "last": (lambda: F.last_day("o_orderdate"), "last_day(o_orderdate)"),
    "mon": (lambda: F.trunc("o_orderdate", "month"), "CAST(date_trunc('month', o_orderdate) AS DATE)"),
    "fmt": (lambda: F.date_format("o_orderdate", "yyyy/MM/dd"), "strftime(o_orderdate, '%Y/%m/%d')"),
    "am": (lambda: F.add_months("o_orderdate", 2), "CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE)"),
    "parsed": (lambda: F.to_date(F.date_format("o_orderdate", "dd.MM.yyyy"), "dd.MM.yyyy"), "CAST(o_orderdate AS DATE)"),
})
_family("fn_time", "events", "event_id", {
    "h": (lambda: F.hour("ts"), "CAST(hour(ts) AS INTEGER)"),
    "mi": (lambda: F.minute("ts"), "CAST(minute(ts) AS INTEGER)"),
    "se": (lambda: F.second("ts"), "CAST(second(ts) AS INTEGER)"),
    "unix": (lambda: F.unix_timestamp(c("ts").cast("timestamp")), "CAST(floor(epoch(ts)) AS BIGINT)"),
    "dt": (lambda: F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"), "strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S')"),
})
_ARR = "[p_size, p_size % 7, p_size % 3, p_size % 7]"


def _arr():
    return F.array(c("p_size"), c("p_size") % 7, c("p_size") % 3, c("p_size") % 7)


def _join(x):
    return F.array_join(F.transform(x, lambda v: v.cast("string")), ",")


def _joined(x):
    return f"array_to_string({x}, ',')"


_family("fn_array", "part", "p_partkey", {
    "sorted": (lambda: _join(F.array_sort(_arr())), _joined(f"list_sort({_ARR})")),
    "down": (lambda: _join(F.sort_array(_arr(), False)), _joined(f"list_reverse_sort({_ARR})")),
    "dis": (lambda: _join(F.array_sort(F.array_distinct(_arr()))), _joined(f"list_sort(list_distinct({_ARR}))")),
    "has": (lambda: F.array_contains(_arr(), 3), f"list_contains({_ARR}, 3)"),
    "pos": (lambda: F.array_position(_arr(), 2).cast("int"), f"CAST(coalesce(list_position({_ARR}, 2), 0) AS INTEGER)"),
    "mx": (lambda: F.array_max(_arr()), f"list_max({_ARR})"),
    "mn": (lambda: F.array_min(_arr()), f"list_min({_ARR})"),
    "sl": (lambda: _join(F.slice(_arr(), 2, 2)), _joined(f"({_ARR})[2:3]")),
    "el": (lambda: F.element_at(_arr(), -1), f"({_ARR})[-1]"),
    "cat": (lambda: _join(F.concat(_arr(), F.array(F.lit(9)))), _joined(f"list_concat({_ARR}, [9])")),
    "inter": (lambda: _join(F.array_sort(F.array_intersect(_arr(), F.array(*map(F.lit, (0, 1, 2)))))), _joined(f"list_sort(list_distinct(list_intersect({_ARR}, [0, 1, 2])))")),
    "over": (lambda: F.arrays_overlap(_arr(), F.array(F.lit(1), F.lit(5))), f"list_has_any({_ARR}, [1, 5])"),
    "rev": (lambda: _join(F.reverse(_arr())), _joined(f"list_reverse({_ARR})")),
    "seq": (lambda: _join(F.sequence(F.lit(1), c("p_size") % 4 + 1)), _joined("range(1, p_size % 4 + 2)")),
    "flat": (lambda: _join(F.flatten(F.array(_arr(), F.array(F.lit(7))))), _joined(f"flatten([{_ARR}, [7]])")),
    "sz": (lambda: F.size(_arr()), f"CAST(len({_ARR}) AS INTEGER)"),
    "rm": (lambda: _join(F.array_remove(_arr(), 1)), _joined(f"list_filter({_ARR}, lambda x: x <> 1)")),
    "rpt": (lambda: _join(F.array_repeat(c("p_size"), 2)), _joined("[p_size, p_size]")),
})
_family("fn_hof", "part", "p_partkey", {
    "tr": (lambda: _join(F.transform(_arr(), lambda x: x * 2 + 1)), _joined(f"list_transform({_ARR}, lambda x: x * 2 + 1)")),
    "fi": (lambda: _join(F.filter(_arr(), lambda x: x > 2)), _joined(f"list_filter({_ARR}, lambda x: x > 2)")),
    "ag": (lambda: F.aggregate(_arr(), F.lit(0), lambda a, x: a + x), f"CAST(list_sum({_ARR}) AS INTEGER)"),
    "ex": (lambda: F.exists(_arr(), lambda x: x == 0), f"list_bool_or(list_transform({_ARR}, lambda x: x = 0))"),
    "al": (lambda: F.forall(_arr(), lambda x: x < 40), f"list_bool_and(list_transform({_ARR}, lambda x: x < 40))"),
    "zw": (lambda: _join(F.zip_with(_arr(), F.array(*map(F.lit, (1, 2, 3, 4))), lambda a, b: a * b)), _joined(f"list_transform(list_zip({_ARR}, [1, 2, 3, 4]), lambda z: z[1] * z[2])")),
})


def _map():
    return F.create_map(F.lit("size"), c("p_size"), F.lit("seven"), c("p_size") % 7)


_family("fn_map", "part", "p_partkey", {
    "ks": (lambda: F.array_join(F.array_sort(F.map_keys(_map())), ","), "'seven,size'"),
    "vs": (lambda: F.aggregate(F.map_values(_map()), F.lit(0), lambda a, x: a + x), "CAST(p_size + p_size % 7 AS INTEGER)"),
    "at": (lambda: _map()["size"], "p_size"),
    "big": (lambda: F.size(F.map_filter(_map(), lambda k, v: v > 5)), "CAST((CASE WHEN p_size > 5 THEN 1 ELSE 0 END) + (CASE WHEN p_size % 7 > 5 THEN 1 ELSE 0 END) AS INTEGER)"),
    "tv": (lambda: F.transform_values(_map(), lambda k, v: v * 10)["size"], "p_size * 10"),
    "tk": (lambda: F.transform_keys(_map(), lambda k, v: F.upper(k))["SEVEN"], "p_size % 7"),
    "cc": (lambda: F.size(F.map_concat(_map(), F.create_map(F.lit("x"), F.lit(1)))), "CAST(3 AS INTEGER)"),
    "fe": (lambda: F.map_from_entries(F.array(F.struct(F.lit("k"), c("p_size"))))["k"], "p_size"),
    "zw": (lambda: F.map_zip_with(_map(), _map(), lambda k, a, b: a + b)["size"], "p_size * 2"),
})
_family("fn_json", "events", "event_id", {
    "k": (lambda: F.get_json_object("props", "$.k").cast("int"), "CAST(json_extract_string(props, '$.k') AS INTEGER)"),
    "f": (lambda: F.from_json("props", T.StructType([T.StructField("k", T.IntegerType())]))["k"], "CAST(json_extract(props, '$.k') AS INTEGER)"),
    "t": (lambda: F.to_json(F.struct(c("user_id").alias("u"), c("event_type").alias("e"))), "'{\"u\":' || user_id || ',\"e\":\"' || event_type || '\"}'"),
    "none": (lambda: F.get_json_object("props", "$.absent"), "json_extract_string(props, '$.absent')"),
})
_family("fn_cast_null", "events", "event_id", {
    "i": (lambda: c("value").cast("int"), "CAST(trunc(value) AS INTEGER)"),
    "s": (lambda: c("user_id").cast("string"), "CAST(user_id AS VARCHAR)"),
    "bad": (lambda: c("event_type").try_cast("int"), "TRY_CAST(event_type AS INTEGER)"),
    "nul": (lambda: F.nullif(c("user_id") % 3, F.lit(0)), "nullif(user_id % 3, 0)"),
    "co": (lambda: F.coalesce(F.nullif(c("user_id") % 3, F.lit(0)), F.lit(-1)), "coalesce(nullif(user_id % 3, 0), -1)"),
    "div": (lambda: F.try_divide(F.lit(1.0), (c("user_id") % 3).cast("double")), "1.0::DOUBLE / nullif(user_id % 3, 0)"),
    "isn": (lambda: F.isnull(F.nullif(c("user_id") % 3, F.lit(0))), "nullif(user_id % 3, 0) IS NULL"),
    "nan": (lambda: F.nanvl(F.when(c("user_id") % 2 == 0, F.lit(float("nan"))).otherwise(1.5), F.lit(0.5)), "CASE WHEN user_id % 2 = 0 THEN 0.5 ELSE 1.5 END::DOUBLE"),
})


@query("fn_explode", "SELECT n_nationkey, i AS pos, x AS part FROM (SELECT n_nationkey, unnest(string_split(n_name, 'A')) AS x, generate_subscripts(string_split(n_name, 'A'), 1) - 1 AS i FROM nation)")
def fn_explode(spark, sf_dir):
    return load(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(F.split("n_name", "A")).alias("pos", "part")).select("n_nationkey", F.col("pos").cast("long").alias("pos"), "part")


@query("fn_explode_outer", "SELECT r_regionkey, x FROM region LEFT JOIN (SELECT r_regionkey, unnest(CASE WHEN r_regionkey % 2 = 0 THEN [1, 2] ELSE [] END) AS x FROM region) t USING (r_regionkey)")
def fn_explode_outer(spark, sf_dir):
    none = F.array().cast("array<int>")
    return load(spark, sf_dir, "region").select("r_regionkey", F.explode_outer(F.when(F.col("r_regionkey") % 2 == 0, F.array(F.lit(1), F.lit(2))).otherwise(none)).alias("x"))


@query("fn_struct", "SELECT c_custkey, upper(c_mktsegment) AS seg, c_nationkey + 1 AS nk FROM customer")
def fn_struct(spark, sf_dir):
    s = F.struct(F.col("c_mktsegment").alias("seg"), F.col("c_nationkey").alias("nk"), F.lit(0).alias("gone"))
    s = s.withField("seg", F.upper("c_mktsegment")).withField("nk", F.col("c_nationkey") + 1).dropFields("gone")
    return load(spark, sf_dir, "customer").select("c_custkey", s.alias("s")).select("c_custkey", "s.*")


@query("fn_csv", "SELECT r_regionkey, CAST(r_regionkey AS VARCHAR) || ',' || r_name AS line, r_name AS back FROM region")
def fn_csv(spark, sf_dir):
    line = F.to_csv(F.struct("r_regionkey", "r_name"))
    return load(spark, sf_dir, "region").select("r_regionkey", line.alias("line"), F.from_csv(line, F.lit("k INT, name STRING"))["name"].alias("back"))


@query("fn_window_tumbling", "SELECT event_type, strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY 1, 2")
def fn_window_tumbling(spark, sf_dir):
    w = load(spark, sf_dir, "events").groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n"))
    return w.select("event_type", F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n")


_family("fn_math2", "lineitem", "l_orderkey", {
    "n": (lambda: c("l_linenumber"), "l_linenumber"),
    "sh": (lambda: F.round(F.sinh("l_discount"), 6), "round(sinh(l_discount), 6)"),
    "ch": (lambda: F.round(F.cosh("l_discount"), 6), "round(cosh(l_discount), 6)"),
    "th": (lambda: F.round(F.tanh("l_discount"), 6), "round(tanh(l_discount), 6)"),
    "as": (lambda: F.round(F.asin("l_discount"), 6), "round(asin(l_discount), 6)"),
    "ac": (lambda: F.round(F.acos("l_discount"), 6), "round(acos(l_discount), 6)"),
    "tn": (lambda: F.round(F.tan("l_discount"), 6), "round(tan(l_discount), 6)"),
    "cs": (lambda: F.round(F.cos("l_quantity"), 6), "round(cos(l_quantity), 6)"),
    "hy": (lambda: F.round(F.hypot("l_quantity", "l_linenumber"), 6), "round(sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber), 6)"),
    "e1": (lambda: F.round(F.expm1("l_tax"), 6), "round(exp(l_tax) - 1, 6)"),
    "l1": (lambda: F.round(F.log1p("l_tax"), 6), "round(ln(1 + l_tax), 6)"),
    "br": (lambda: F.bround(c("l_linenumber") / 2, 0), "round_even(l_linenumber / 2, 0)"),
    "pm": (lambda: F.pmod(c("l_linenumber") - 4, F.lit(3)), "((l_linenumber - 4) % 3 + 3) % 3"),
    "wb": (lambda: F.width_bucket("l_quantity", F.lit(0.0), F.lit(50.0), F.lit(5)), "CAST(least(floor(l_quantity / 10) + 1, 6) AS BIGINT)"),
})
_family("fn_string2", "part", "p_partkey", {
    "left": (lambda: F.left("p_name", F.lit(3)), "left(p_name, 3)"),
    "right": (lambda: F.right("p_name", F.lit(3)), "right(p_name, 3)"),
    "pre": (lambda: F.substring_index("p_name", " ", 1), "split_part(p_name, ' ', 1)"),
    "loc": (lambda: F.locate("a", "p_name", 2), "CAST(CASE WHEN instr(substr(p_name, 2), 'a') = 0 THEN 0 ELSE instr(substr(p_name, 2), 'a') + 1 END AS INTEGER)"),
    "ov": (lambda: F.overlay("p_brand", F.lit("XX"), 2, 2), "left(p_brand, 1) || 'XX' || substr(p_brand, 4)"),
    "fs": (lambda: F.format_string("%05d|%s", "p_size", "p_brand"), "lpad(CAST(p_size AS VARCHAR), 5, '0') || '|' || p_brand"),
    "fn": (lambda: F.format_number(c("p_size") * 1000, 0), "CAST(p_size AS VARCHAR) || ',000'"),
    "cv": (lambda: F.conv(c("p_size").cast("string"), 10, 16), "printf('%X', p_size)"),
    "chr": (lambda: F.char(c("p_size") % 26 + 65), "chr(p_size % 26 + 65)"),
    "oct": (lambda: F.octet_length("p_name"), "CAST(strlen(p_name) AS INTEGER)"),
    "btr": (lambda: F.btrim("p_brand", F.lit("B")), "trim(p_brand, 'B')"),
    "un": (lambda: F.decode(F.unbase64(F.base64(F.encode("p_brand", "UTF-8"))), "UTF-8"), "p_brand"),
})
_family("fn_date2", "orders", "o_orderkey", {
    "mb": (lambda: F.floor(F.months_between("o_orderdate", F.lit("1990-01-01").cast("date"))), "CAST(datediff('month', DATE '1990-01-01', CAST(o_orderdate AS DATE)) AS BIGINT)"),
    "nd": (lambda: F.next_day("o_orderdate", "Mon"), "CAST(o_orderdate AS DATE) + CAST(CASE WHEN isodow(o_orderdate) = 1 THEN 7 ELSE 8 - isodow(o_orderdate) END AS INTEGER)"),
    "fu": (lambda: F.from_unixtime(c("o_orderkey") * 3600, "yyyy-MM-dd HH:mm"), "strftime(make_timestamp(o_orderkey * 3600 * 1000000), '%Y-%m-%d %H:%M')"),
    "md": (lambda: F.make_date(F.year("o_orderdate"), F.lit(2), F.lit(1)), "make_date(year(o_orderdate), 2, 1)"),
    "ex": (lambda: F.extract(F.lit("WEEK"), "o_orderdate"), "CAST(weekofyear(o_orderdate) AS INTEGER)"),
    "tz": (lambda: F.date_format(F.from_utc_timestamp(c("o_orderdate").cast("timestamp"), "+02:00"), "HH"), "strftime(o_orderdate + INTERVAL 2 HOUR, '%H')"),
})


@query("fn_engine_only", None)
def fn_engine_only(spark, sf_dir):
    """Functions whose values are this engine's own, or vary by run: hashes, sound codes, partition and file names, random numbers."""
    p = load(spark, sf_dir, "part")
    return p.select(
        "p_partkey", F.initcap("p_name").alias("ic"), F.soundex("p_name").alias("sx"), F.crc32(c("p_name").cast("binary")).alias("c32"), F.xxhash64("p_name").alias("xx"), F.hash("p_name").alias("h"),
        F.spark_partition_id().alias("pid"), F.monotonically_increasing_id().alias("mid"), F.input_file_name().alias("file"), F.rand(7).alias("r"), F.randn(7).alias("rn"), F.shuffle(_arr()).alias("sh"),
        F.schema_of_json(F.lit('{"a": 1}')).alias("sj"), F.schema_of_csv(F.lit("1,a")).alias("sc"), F.current_date().alias("cd"), F.current_timestamp().alias("ct"), F.signum(F.rint(c("p_retailprice"))).alias("rt"),
    )


@query("fn_json_tuple", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn_json_tuple(spark, sf_dir):
    return load(spark, sf_dir, "events").select("event_id", F.json_tuple("props", "k").alias("k"))
_family("fn_more_math", "lineitem", "l_orderkey", {
    "n": (lambda: c("l_linenumber"), "l_linenumber"),
    "at": (lambda: F.round(F.atan("l_quantity"), 9), "round(atan(l_quantity), 9)"),
    "ach": (lambda: F.round(F.acosh("l_quantity"), 9), "round(acosh(l_quantity), 9)"),
    "ash": (lambda: F.round(F.asinh("l_quantity"), 9), "round(asinh(l_quantity), 9)"),
    "ath": (lambda: F.round(F.atanh("l_discount"), 9), "round(atanh(l_discount), 9)"),
    "lg": (lambda: F.round(F.log(3.0, c("l_quantity")), 9), "round(ln(l_quantity) / ln(3), 9)"),
    "sru": (lambda: F.shiftrightunsigned(c("l_partkey"), 2), "l_partkey >> 2"),
    "sr": (lambda: F.shiftright(c("l_partkey"), 1), "l_partkey >> 1"),
    "sl": (lambda: F.shiftleft(c("l_partkey"), 1), "l_partkey << 1"),
    "br": (lambda: F.bround(c("l_extendedprice") / 1000, 0), "round_even(l_extendedprice / 1000, 0)"),
    "hyp": (lambda: F.round(F.hypot("l_quantity", "l_tax"), 9), "round(sqrt(l_quantity * l_quantity + l_tax * l_tax), 9)"),
    "l1p": (lambda: F.round(F.log1p("l_discount"), 9), "round(ln(1 + l_discount), 9)"),
    "em1": (lambda: F.round(F.expm1("l_discount"), 9), "round(exp(l_discount) - 1, 9)"),
    "sg": (lambda: F.signum(c("l_quantity") - 25), "CAST(sign(l_quantity - 25) AS DOUBLE)"),
    "deg": (lambda: F.round(F.degrees("l_tax"), 9), "round(degrees(l_tax), 9)"),
    "fac": (lambda: F.factorial(c("l_linenumber")), "CAST(factorial(l_linenumber) AS BIGINT)"),
})
_family("fn_more_string", "part", "p_partkey", {
    "rt": (lambda: F.rtrim(F.concat("p_brand", F.lit("  "))), "rtrim(p_brand || '  ')"),
    "unh": (lambda: F.decode(F.unhex(F.hex("p_brand")), "UTF-8"), "decode(unhex(hex(encode(p_brand))))"),
    "ub": (lambda: F.decode(F.unbase64(F.base64(F.encode("p_brand", "UTF-8"))), "UTF-8"), "p_brand"),
    "ini": (lambda: F.initcap(F.lower("p_brand")), "upper(p_brand[1]) || lower(p_brand[2:])"),
    "loc": (lambda: F.locate("a", "p_name", 2), "CAST(CASE WHEN instr(p_name[2:], 'a') = 0 THEN 0 ELSE instr(p_name[2:], 'a') + 1 END AS INTEGER)"),
    "ovl": (lambda: F.overlay("p_brand", F.lit("XX"), 2, 2), "p_brand[1] || 'XX' || p_brand[4:]"),
    "sx": (lambda: F.substring_index("p_type", " ", 1), "split_part(p_type, ' ', 1)"),
    "bl": (lambda: F.bit_length("p_brand"), "CAST(bit_length(p_brand) AS INTEGER)"),
    "sha": (lambda: F.sha2("p_name", 256), "sha256(p_name)"),
    "chk": (lambda: F.coalesce(F.assert_true(c("p_size") > 0).cast("string"), F.lit("checked")), "'checked'"),
    "bin": (lambda: F.bin(c("p_size")), "bin(p_size)"),
    "cnv": (lambda: F.conv(c("p_size").cast("string"), 10, 16), "to_base(p_size, 16)"),
})
_family("fn_more_array", "part", "p_partkey", {
    "uni": (lambda: F.array_sort(F.array_union(F.array(c("p_size"), F.lit(3)), F.array(F.lit(3), F.lit(60)))), "list_sort(list_distinct([p_size, 3, 60]))"),
    "exc": (lambda: F.array_except(F.array(c("p_size"), F.lit(3)), F.array(F.lit(3))), "CASE WHEN p_size = 3 THEN CAST([] AS INTEGER[]) ELSE [p_size] END"),
    "zip": (lambda: F.transform(F.arrays_zip(F.array(c("p_size"), F.lit(1)).alias("x"), F.array(F.lit(7), c("p_size")).alias("y")), lambda z: z["x"] * 100 + z["y"]), "[p_size * 100 + 7, 100 + p_size]"),
    "ent": (lambda: F.transform(F.map_entries(F.create_map(F.lit("k"), c("p_size"))), lambda e: F.concat(e["key"], e["value"].cast("string"))), "['k' || p_size]"),
    "mfa": (lambda: F.map_from_arrays(F.array(F.lit("a"), F.lit("b")), F.array(c("p_size"), F.lit(0)))["a"], "p_size"),
    "ovp": (lambda: F.arrays_overlap(F.array(c("p_size")), F.array(F.lit(3), F.lit(5))), "p_size IN (3, 5)"),
    "rem": (lambda: F.array_remove(F.array(c("p_size"), F.lit(5)), 5), "CASE WHEN p_size = 5 THEN CAST([] AS INTEGER[]) ELSE [p_size] END"),
    "rpt": (lambda: F.array_repeat(c("p_size"), 2), "[p_size, p_size]"),
    "fl": (lambda: F.flatten(F.array(F.array(c("p_size")), F.array(F.lit(1)))), "[p_size, 1]"),
    "mc": (lambda: F.map_concat(F.create_map(F.lit("a"), c("p_size")), F.create_map(F.lit("b"), F.lit(2)))["b"], "2"),
})
_family("fn_more_time", "orders", "o_orderkey", {
    "ts": (lambda: F.to_timestamp(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).cast("long"), "CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT)"),
    "sec": (lambda: F.timestamp_seconds(F.lit(86400) * c("o_custkey").cast("long")).cast("date"), "CAST(DATE '1970-01-01' + CAST(o_custkey AS INTEGER) AS DATE)"),
    "utc": (lambda: F.to_utc_timestamp("o_orderdate", "+02:00").cast("long"), "CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) - 7200"),
    "frm": (lambda: F.from_utc_timestamp("o_orderdate", "+02:00").cast("long"), "CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) + 7200"),
    "mk": (lambda: F.make_date(F.year("o_orderdate"), F.month("o_orderdate"), F.lit(1)), "CAST(date_trunc('month', o_orderdate) AS DATE)"),
    "ld": (lambda: F.last_day("o_orderdate"), "last_day(o_orderdate)"),
    "woy": (lambda: F.weekofyear("o_orderdate"), "CAST(weekofyear(o_orderdate) AS INTEGER)"),
    "ux": (lambda: F.unix_timestamp("o_orderdate"), "CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT)"),
})


@query("fn_posexplode_outer", "SELECT p_partkey, CAST(CASE WHEN p_size > 25 THEN i END AS INTEGER) AS pos, CASE WHEN p_size > 25 THEN p_size + i END AS x FROM part, (VALUES (0), (1)) v(i) WHERE p_size > 25 OR i = 0")
def fn_posexplode_outer(spark, sf_dir):
    """Rows without an array stay, with nulls."""
    p = load(spark, sf_dir, "part").withColumn("a", F.when(c("p_size") > 25, F.array(c("p_size"), c("p_size") + 1)))
    return p.select("p_partkey", F.posexplode_outer("a").alias("pos", "x"))
