"""Queries of the int8 kernels, over quantized embeddings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as I
from ..operators.attention import attention, feed_forward, fixture, over_rows
from . import views as V
from .registry import query


def _wrap(x: Column) -> Column:
    return F.pmod(x + 128, F.lit(256).cast("bigint")) - 128


def _weights(n: int, start: int = 0) -> Column:
    return F.transform(F.sequence(I.big(start), I.big(start + n - 1)), lambda i: _wrap(i * 7 - 13))


def _biases(n: int, start: int = 0) -> Column:
    return F.transform(F.sequence(I.big(start), I.big(start + n - 1)), lambda i: _wrap(I.big(5) - i * 3))


def _matrix(rows: int, columns: int, start: int = 0) -> Column:
    return F.transform(F.sequence(I.big(0), I.big(rows - 1)), lambda o: F.transform(F.sequence(I.big(0), I.big(columns - 1)), lambda i: _wrap((o * columns + i + start) * 7 - 13)))


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, q): embeddings in Q1.7, and the kernels' weights as one row of columns beside them."""
    return V.table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda e: I.quantized(e.cast("double"))).alias("q"))


def _joined(c: Column) -> Column:
    return F.array_join(c.cast("array<string>"), ",")


_W = "((((7 * ({0}) - 13) + 128) % 256 + 256) % 256 - 128)"
_B = "((((5 - 3 * ({0})) + 128) % 256 + 256) % 256 - 128)"
_SAT = "greatest(least({0}, 127), -128)"
_SHIFT = "CAST(floor(({0}) / {1}.0) AS BIGINT)"
_RQ = lambda acc, s=7: _SAT.format(_SHIFT.format(f"({acc}) + {1 << (s - 1)}", 1 << s))
_Q = "q AS (SELECT vec_id, list_transform(embedding, lambda e: greatest(least(CAST(round_even(CAST(e AS DOUBLE) * 128, 0) AS BIGINT), 127), -128)) AS q FROM embeddings)"
_DOT = "list_sum(list_transform(range({n}), lambda i: CAST({x} * {w} AS BIGINT)))"
_RNE = """CASE WHEN {s} <= 0 THEN greatest(least({a}, 127), -128) ELSE greatest(least(CAST(round_even({a} / CAST(1 << CAST({s} AS INTEGER) AS DOUBLE), 0) AS BIGINT), 127), -128) END"""
_BITS = "CASE WHEN {0} = 0 THEN 0 ELSE length(bin({0})) END"


@query(f"WITH {_Q} SELECT vec_id, array_to_string(q, ',') AS q FROM q")
def quantize_int8(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _joined(F.col("q")).alias("q"))


@query(f"WITH {_Q} SELECT vec_id, array_to_string(list_transform(q, lambda v: {_RQ('v * 577 + vec_id')}), ',') AS y FROM q")
def requant(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _joined(F.transform("q", lambda v: I.requant(v * 577 + F.col("vec_id"), 7))).alias("y"))


@query(f"WITH {_Q} SELECT vec_id, array_to_string(list_transform(q, lambda v: {_RNE.format(s='(vec_id % 9)', a='(v * 37)')}), ',') AS y FROM q")
def requant_rne(spark, sf_dir):
    return _vectors(spark, sf_dir).select("vec_id", _joined(F.transform("q", lambda v: I.requant_even(v * 37, F.col("vec_id") % 9))).alias("y"))


@query(f"WITH {_Q}, a AS (SELECT vec_id, list_transform(q, lambda v: v * (vec_id + 1)) AS a FROM q), s AS (SELECT *, list_max(list_transform(a, lambda v: abs(v))) AS m FROM a), t AS (SELECT *, greatest(0, {_BITS.format('m')} - 7) AS s FROM s) SELECT vec_id, s::BIGINT AS shift, array_to_string(list_transform(a, lambda v: {_RNE.format(s='s', a='v')}), ',') AS y FROM t")
def dyn_quant(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", F.transform("q", lambda v: v * (F.col("vec_id") + 1)).alias("a")).withColumn("shift", I.dynamic_shift(F.col("a")))
    return rows.select("vec_id", F.col("shift").cast("bigint").alias("shift"), _joined(F.transform("a", lambda v: I.requant_even(v, F.col("shift")))).alias("y"))


@query("SELECT p_partkey, CAST(floor(sqrt(p_partkey * p_partkey * 3 + p_partkey)) AS BIGINT) AS root, CAST(floor(sqrt(p_partkey * p_partkey)) AS BIGINT) AS same FROM part")
def isqrt(spark, sf_dir):
    k = F.col("p_partkey")
    return V.table(spark, sf_dir, "part").select("p_partkey", I.isqrt(k * k * 3 + k).alias("root"), I.isqrt(k * k).alias("same"))


@query("""WITH m AS (SELECT p_partkey, (p_partkey * 37 % 6000) * 94548 AS m FROM part), z AS (SELECT *, m // 16777216 AS z, (m % 16777216) // 256 AS f FROM m),
  p AS (SELECT *, (11279 * f * f) // 4294967296 + CAST(floor(-44047 * f / 65536.0) AS BIGINT) + 65536 AS p FROM z) SELECT p_partkey, CAST(CASE WHEN z >= 17 THEN 0 ELSE p // (1 << CAST(z AS INTEGER)) END AS BIGINT) AS e FROM p""")
def exp_neg(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", I.exp_neg(-(F.col("p_partkey") * 37 % 6000), 8).alias("e"))


@query("SELECT p_partkey, CAST(floor(((p_partkey * 91 % 4001 - 2000) * 8192 + 1048576) / 2097152.0) AS BIGINT) AS s FROM part")
def score_shift(spark, sf_dir):
    return V.table(spark, sf_dir, "part").select("p_partkey", I.score_shift(F.col("p_partkey") * 91 % 4001 - 2000, 8192, 21).alias("s"))


@query(f"WITH {_Q} SELECT vec_id, array_to_string(list_transform(range(2048), lambda i: {_RQ('q[i // 32 + 1] * ' + _W.format('i') + ' + ' + _B.format('i') + ' * 128')}), ',') AS y FROM q")
def int8_tokenizer(spark, sf_dir):
    """64 features by 32."""
    bias = F.transform(F.sequence(I.big(0), I.big(63)), lambda o: F.transform(F.sequence(I.big(0), I.big(31)), lambda i: _wrap(I.big(5) - (o * 32 + i) * 3)))
    rows = _vectors(spark, sf_dir).select("vec_id", F.col("q").alias("x"), _matrix(64, 32).alias("w"), bias.alias("b"))
    return rows.select("vec_id", _joined(I.tokenizer(F.col("x"), F.col("w"), F.col("b"))).alias("y"))


@query(f"""WITH {_Q}, s AS (SELECT vec_id, q, CAST(list_sum(q) AS BIGINT) AS s, CAST(list_sum(list_transform(q, lambda v: v * v)) AS BIGINT) AS ss FROM q),
  r AS (SELECT *, greatest(1, CAST(floor(sqrt(64 * ss - s * s + 168)) AS BIGINT)) AS r FROM s), n AS (SELECT *, (16777216 + r // 2) // r AS inv FROM r)
  SELECT vec_id, array_to_string(list_transform(range(64), lambda i: {_RQ('(64 * q[i + 1] - s) * inv * ' + _W.format('i') + ' + ' + _B.format('i') + ' * 16777216', 24)}), ',') AS y FROM n""")
def int8_layer_norm(spark, sf_dir):
    rows = _vectors(spark, sf_dir).select("vec_id", "q", _weights(64).alias("g"), _biases(64).alias("b"))
    return rows.select("vec_id", _joined(I.layer_norm(F.col("q"), F.col("g"), F.col("b"), 64, 168)).alias("y"))


def _layer(n_in: int, n_out: int, x: str, start: int, relu: bool, bias_start: int) -> str:
    acc = _DOT.format(n=n_in, x=f"{x}[i + 1]", w=_W.format(f"o * {n_in} + i + {start}")) + " + " + _B.format(f"o + {bias_start}") + " * 128"
    body = _RQ(f"CAST({acc} AS BIGINT)")
    return f"list_transform(range({n_out}), lambda o: {f'greatest(0, {body})' if relu else body})"


@query(f"WITH {_Q}, h AS (SELECT vec_id, {_layer(64, 64, 'q', 0, True, 0)} AS h FROM q) SELECT vec_id, array_to_string({_layer(64, 64, 'h', 11, False, 5)}, ',') AS y FROM h")
def int8_ffn(spark, sf_dir):
    """64 to 64 to 64; wide layers run as integer matrix products in Arrow batches."""
    w1, w2 = fixture(64 * 64)[0].reshape(64, 64), fixture(64 * 64, 11)[0].reshape(64, 64)
    b1, b2 = fixture(64)[1], fixture(64, 5)[1]
    made = over_rows(_vectors(spark, sf_dir), "vec_id", "q", lambda x: feed_forward(x, w1, b1, w2, b2))
    return made.select("vec_id", _joined(F.col("y")).alias("y"))


@query(f"WITH {_Q}, h AS (SELECT vec_id, {_layer(64, 4, 'q', 0, True, 0)} AS h FROM q) SELECT vec_id, array_to_string({_layer(4, 64, 'h', 11, False, 5)}, ',') AS y FROM h")
def int8_ffn_columns(spark, sf_dir):
    """64 to 4 to 64, as one column expression."""
    rows = _vectors(spark, sf_dir).select("vec_id", F.col("q").alias("x"), _matrix(4, 64).alias("w1"), _biases(4).alias("b1"), _matrix(64, 4, 11).alias("w2"), _biases(64, 5).alias("b2"))
    return rows.select("vec_id", _joined(I.feed_forward(*map(F.col, ("x", "w1", "b1", "w2", "b2")))).alias("y"))


def _plain(n_in: int, n_out: int, x: str, start: int) -> str:
    acc = _DOT.format(n=n_in, x=f"{x}[i + 1]", w=_W.format(f"o * {n_in} + i + {start}")) + " + " + _B.format("o")
    return f"list_transform(range({n_out}), lambda o: greatest(0, CAST({acc} AS BIGINT)))"


_DYN = lambda a: f"greatest(0, {_BITS.format(f'list_max({a})')} - 7)"


@query(f"""WITH {_Q}, x AS (SELECT vec_id, list_transform(q, lambda v: CASE WHEN v > 0 THEN 1 ELSE 0 END) AS x FROM q),
  a AS (SELECT vec_id, {_plain(64, 16, 'x', 0)} AS a FROM x), a1 AS (SELECT *, {_DYN('a')} AS s FROM a), h AS (SELECT vec_id, list_transform(a, lambda v: {_RNE.format(s='s', a='v')}) AS h FROM a1),
  b AS (SELECT vec_id, {_plain(16, 16, 'h', 3)} AS a FROM h), b1 AS (SELECT *, {_DYN('a')} AS s FROM b), g AS (SELECT vec_id, list_transform(a, lambda v: {_RNE.format(s='s', a='v')}) AS h FROM b1),
  c AS (SELECT vec_id, CAST({_DOT.format(n=16, x='h[i + 1]', w=_W.format('i + 9'))} + {_B.format('0')} AS BIGINT) AS a FROM g), d AS (SELECT *, greatest(0, {_BITS.format('abs(a)')} - 7) AS s FROM c)
  SELECT vec_id, {_RNE.format(s='s', a='a')}::BIGINT AS y, s::BIGINT AS shift FROM d""")
def int8_mlp(spark, sf_dir):
    """64 bits to 16 to 16 to one."""
    x = F.transform("q", lambda v: F.when(v > 0, I.big(1)).otherwise(I.big(0)))
    rows = _vectors(spark, sf_dir).select("vec_id", x.alias("x"), _matrix(16, 64).alias("w1"), _biases(16).alias("b1"), _matrix(16, 16, 3).alias("w2"), _weights(16, 9).alias("w3"))
    return rows.select("vec_id", I.mlp(F.col("x"), F.col("w1"), F.col("b1"), F.col("w2"), F.col("b1"), F.col("w3"), F.lit(5).cast("bigint")).alias("o")).select("vec_id", "o.y", "o.shift")


_AT = lambda x, i: f"{x}[({i}) + 1]"
_SUM = lambda n, name, body: f"CAST(list_sum(list_transform(range({n}), lambda {name}: CAST({body} AS BIGINT))) AS BIGINT)"
_EACH = lambda n, name, body: f"list_transform(range({n}), lambda {name}: {body})"
_AFFINE = lambda x, at: _RQ(f"{_SUM(16, 'i', f'{_AT(x, at)} * {{w}}')} + {{b}} * 128")
# Positions: qkv is token * 48 + (q, k, v) * 16 + head * 4 + part; s and e are head * 16 + query * 4 + key; c is token * 16 + head * 4 + part.
_ATTENTION = f"""WITH {_Q},
  qkv AS (SELECT vec_id, {_EACH(192, "o", _AFFINE("q", "(o // 48) * 16 + i").format(w=_W.format("(o % 48) * 16 + i"), b=_B.format("o % 48")))} AS x FROM q),
  s AS (SELECT *, {_EACH(64, "o", _SHIFT.format(_SUM(4, "i", f"{_AT('x', '(o // 4 % 4) * 48 + (o // 16) * 4 + i')} * {_AT('x', '(o % 4) * 48 + 16 + (o // 16) * 4 + i')}") + " * 8192 + 524288", 1 << 20))} AS s FROM qkv),
  d AS (SELECT *, {_EACH(64, "o", "94548 * (list_max(s[(o // 4) * 4 + 1 : (o // 4) * 4 + 4]) - " + _AT("s", "o") + ")")} AS m FROM s),
  e AS (SELECT *, list_transform(m, lambda m: CASE WHEN m // 16777216 > 16 THEN 0 ELSE
    ((11279 * (m % 16777216 // 256) * (m % 16777216 // 256)) // 4294967296 + CAST(floor(-44047 * (m % 16777216 // 256) / 65536.0) AS BIGINT) + 65536) // (1 << CAST(m // 16777216 AS INTEGER)) END) AS e FROM d),
  t AS (SELECT *, {_EACH(16, "o", "greatest(1, CAST(list_sum(e[o * 4 + 1 : o * 4 + 4]) AS BIGINT))")} AS t FROM e),
  c AS (SELECT vec_id, {_EACH(64, "o", _RQ("(" + _SUM(4, "i", f"{_AT('e', '(o // 4 % 4) * 16 + (o // 16) * 4 + i')} * {_AT('x', 'i * 48 + 32 + o % 16')}") + ") * ((16777216 + t[(o // 4 % 4) * 4 + o // 16 + 1] // 2) // t[(o // 4 % 4) * 4 + o // 16 + 1])", 24))} AS c FROM t)
  SELECT vec_id, array_to_string({_EACH(64, "o", _AFFINE("c", "(o // 16) * 16 + i").format(w=_W.format("(o % 16) * 16 + i"), b=_B.format("o % 16")))}, ',') AS y FROM c"""


@query(_ATTENTION)
def int8_attention(spark, sf_dir):
    """Four tokens of width 16, four heads; integer NumPy in Arrow batches."""
    made = attention(_vectors(spark, sf_dir), "vec_id", "q", tokens=4, width=16, heads=4)
    return made.select("vec_id", _joined(F.col("y")).alias("y"))
