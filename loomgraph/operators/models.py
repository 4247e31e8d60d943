"""Boosted trees over candidate features, and scoring with weights that are given."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Columns that may not predict: they name rows or give the answer away.
FORBIDDEN = {"label", "y", "candidate", "candidate_id", "world", "world_id", "event_id", "instance_id", "pattern_id", "seed"}


def predictors(df: DataFrame, leave: list[str] | None = None) -> list[str]:
    """The numeric columns that may predict."""
    left = FORBIDDEN | set(leave or [])
    return [c for c, k in df.dtypes if c not in left and k.startswith(("int", "bigint", "double", "float", "decimal"))]


def check_predictors(names: list[str]) -> None:
    if bad := sorted(FORBIDDEN & set(names)):
        raise ValueError(f"columns may not predict: {bad}")


def world_weights(df: DataFrame, world: str = "world") -> DataFrame:
    """df with w: every world weighs the same, and so do its rows."""
    worlds = df.select(F.count_distinct(world).alias("_worlds"))
    return df.join(F.broadcast(worlds)).withColumn("w", 1 / (F.col("_worlds") * F.count("*").over(Window.partitionBy(world)))).drop("_worlds")


def fit_trees(df: DataFrame, names: list[str], y: str = "y", rounds: int = 20, depth: int = 3, weight: str | None = None, seed: int = 7) -> PipelineModel:
    """Gradient-boosted trees; their depth is bounded, not their number of leaves."""
    check_predictors(names)
    more = {"weightCol": weight} if weight else {}
    trees = GBTClassifier(featuresCol="_features", labelCol=y, predictionCol="_called", maxIter=rounds, maxDepth=depth, stepSize=0.1, seed=seed, **more)
    trees = trees.setProbabilityCol("_probability").setRawPredictionCol("_raw")
    return Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_features"), trees]).fit(df)


def score_trees(model: PipelineModel, df: DataFrame, name: str = "logit") -> DataFrame:
    """df with the model's raw score for the positive class."""
    return model.transform(df).withColumn(name, vector_to_array("_raw")[1]).drop("_features", "_called", "_probability", "_raw")


def score_mlp(df: DataFrame, names: list[str], layers: list[tuple[np.ndarray, np.ndarray]], name: str = "logit") -> DataFrame:
    """df with the output of a network of ReLU layers with given weights, scored in Arrow batches."""
    check_predictors(names)

    @F.pandas_udf("double")
    def run(x: pd.DataFrame) -> pd.Series:
        h = x.to_numpy(float)
        for i, (w, b) in enumerate(layers):
            h = h @ w + b
            if i < len(layers) - 1:
                h = np.maximum(h, 0)
        return pd.Series(h[:, 0])

    return df.withColumn(name, run(F.struct(*(F.col(c).cast("double").alias(c) for c in names))))


def message_layer(nodes: DataFrame, edges: DataFrame, by: list[str], own: np.ndarray, other: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(by, node, h): one layer of mean message passing with given weights, ReLU(own h + other mean(h of sources) + bias). nodes: (by, node, h array<double>), edges: (by, src, dst)."""
    width = len(bias)
    sent = edges.join(nodes.withColumnRenamed("node", "src"), [*by, "src"]).select(*by, F.col("dst").alias("node"), *(F.col("h")[i].alias(f"_{i}") for i in range(own.shape[0])))
    means = sent.groupBy(*by, "node").agg(F.array(*(F.avg(f"_{i}") for i in range(own.shape[0]))).alias("m"))
    both = nodes.join(means, [*by, "node"], "left")

    def row(j: int):
        terms = [F.col("h")[i] * float(own[i, j]) + F.coalesce(F.col("m")[i], F.lit(0.0)) * float(other[i, j]) for i in range(own.shape[0])]
        return F.greatest(F.lit(0.0), sum(terms, F.lit(float(bias[j]))))

    return both.select(*by, "node", F.array(*(row(j) for j in range(width))).alias("h"))


def pooled(nodes: DataFrame, by: list[str], width: int) -> DataFrame:
    """(by, pooled): the mean and the maximum of each component over a graph's nodes."""
    return nodes.groupBy(*by).agg(F.array(*(F.avg(F.col("h")[i]) for i in range(width)), *(F.max(F.col("h")[i]) for i in range(width))).alias("pooled"))


def observed(df: DataFrame, by: list[str], x: str, near: float = 0.99) -> DataFrame:
    """by, n, least, most and saturated: the share of values of at least `near` in size."""
    return df.groupBy(*by).agg(F.count(x).alias("n"), F.min(x).alias("least"), F.max(x).alias("most"), F.avg((F.abs(x) >= near).cast("double")).alias("saturated"))


def affine(lists: pa.Array, weight: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """x W + b of a batch of lists, in one product. A null list or element counts as zeros, and so do elements that a shorter list lacks; a longer list raises."""
    n, width = len(lists), weight.shape[0]
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    if n and lengths.max() > width:
        raise ValueError(f"a list of {lengths.max()} numbers for {width} rows of weights")
    given = pc.fill_null(lists.flatten(), 0.0).to_numpy(zero_copy_only=False)
    if len(given) == n * width:
        x = given.reshape(n, width)
    else:
        x = np.zeros((n, width))
        x[np.arange(width) < lengths[:, None]] = given
    return x @ weight + shift


def dense(x, weight: np.ndarray, bias: np.ndarray | None = None, act=None) -> F.Column:
    """x W + b as an array, from an array column or a list of columns; act works on a column. The product of a batch of rows with the weights is taken at once in a task, so a row costs no expression for each weight, and plans grow with the layers and not with products of their widths. A null input counts as zeros."""
    own = (F.array(*x) if isinstance(x, list) else x).cast("array<double>")
    given, shift = np.asarray(weight, dtype=float), np.zeros(weight.shape[1]) if bias is None else np.asarray(bias, dtype=float)
    tanh = act is F.tanh

    @F.arrow_udf("array<double>")
    def run(v: pa.Array) -> pa.Array:
        y = affine(v, given, shift)
        y = np.tanh(y) if tanh else y
        return pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * y.shape[1], pa.int32()), pa.array(y.ravel()))

    return run(own) if tanh or act is None else F.transform(run(own), act)


def with_loops(nodes: DataFrame, edges: DataFrame, by: list[str]) -> DataFrame:
    return edges.select(*by, "src", "dst").unionByName(nodes.select(*by, F.col("node").alias("src"), F.col("node").alias("dst")))


def summed(rows: DataFrame, by: list[str], node: str, x: str, width: int) -> DataFrame:
    return rows.groupBy(*by, F.col(node).alias("node")).agg(F.array(*(F.sum(F.get(x, F.lit(i))) for i in range(width))).alias("m"))


def degree_layer(nodes: DataFrame, edges: DataFrame, by: list[str], weight: np.ndarray, bias: np.ndarray) -> DataFrame:
    """(by, node, h): one directed convolution with given weights. With a loop at every node, the message from u to v is h_u W over the root of out-degree(u) x in-degree(v); parallel edges count."""
    full = with_loops(nodes, edges, by)
    out = full.groupBy(*by, "src").agg(F.count("*").alias("_out"))
    into = full.groupBy(*by, "dst").agg(F.count("*").alias("_in"))
    arcs = full.groupBy(*by, "src", "dst").agg(F.count("*").alias("_m")).join(out, [*by, "src"]).join(into, [*by, "dst"])
    h = nodes.select(*by, F.col("node").alias("src"), dense(F.col("h"), weight).alias("h"))
    scale = F.col("_m") / F.sqrt(F.col("_out") * F.col("_in"))
    sent = arcs.join(h, [*by, "src"]).select(*by, "dst", F.transform("h", lambda x: x * scale).alias("h"))
    width = weight.shape[1]
    return summed(sent, by, "dst", "h", width).select(*by, "node", F.array(*(F.get("m", F.lit(j)) + float(bias[j]) for j in range(width))).alias("h"))


def attention_layer(nodes: DataFrame, edges: DataFrame, by: list[str], weight: np.ndarray, source: np.ndarray, target: np.ndarray, bias: np.ndarray, slope: float = 0.2) -> DataFrame:
    """(by, node, h): one layer of graph attention with given weights. source and target: [head, component]; every node has a loop; the softmax is over the edges into a node, their largest score taken off first."""
    heads, width = source.shape
    h = nodes.select(*by, "node", dense(F.col("h"), weight).alias("h"))
    score = lambda att: F.array(*(sum((F.get("h", F.lit(k * width + i)) * float(att[k, i]) for i in range(width)), F.lit(0.0)) for k in range(heads)))
    a = h.select(*by, F.col("node").alias("src"), "h", score(source).alias("_a"))
    b = h.select(*by, F.col("node").alias("dst"), score(target).alias("_b"))
    leaky = lambda x: F.when(x >= 0, x).otherwise(x * slope)
    scored = with_loops(nodes, edges, by).join(a, [*by, "src"]).join(b, [*by, "dst"]).select(*by, "dst", "h", F.zip_with("_a", "_b", lambda x, y: leaky(x + y)).alias("e"))
    most = scored.groupBy(*by, "dst").agg(F.array(*(F.max(F.get("e", F.lit(k))) for k in range(heads))).alias("_most"))
    risen = scored.join(most, [*by, "dst"]).select(*by, "dst", "h", F.zip_with("e", "_most", lambda x, m: F.exp(x - m)).alias("w"))
    sums = [F.sum(F.get("w", F.lit(k)) * F.get("h", F.lit(k * width + i))).alias(f"_{k}_{i}") for k in range(heads) for i in range(width)]
    total = risen.groupBy(*by, F.col("dst").alias("node")).agg(*sums, *(F.sum(F.get("w", F.lit(k))).alias(f"_w{k}") for k in range(heads)))
    return total.select(*by, "node", F.array(*(F.col(f"_{k}_{i}") / (F.col(f"_w{k}") + 1e-12) + float(bias[k * width + i]) for k in range(heads) for i in range(width))).alias("h"))


def edge_pooled(edges: DataFrame, by: list[str], names: tuple[str, str] = ("log_amount", "since")) -> DataFrame:
    """(by, pooled): the means, then the maxima, of two features over a graph's edges. A feature that is missing or not finite raises."""
    good = [F.when(F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c).cast("double")) < float("inf")), F.col(c).cast("double")).otherwise(F.raise_error(F.lit("an edge feature isn't finite")).cast("double")) for c in names]
    return edges.select(*by, *(c.alias(f"_{i}") for i, c in enumerate(good))).groupBy(*by).agg(F.array(*(F.avg(f"_{i}") for i in range(2)), *(F.max(f"_{i}") for i in range(2))).alias("pooled"))


def cell_network(nodes: DataFrame, edges: DataFrame, cells: DataFrame, w: dict[str, np.ndarray], key: str = "candidate") -> DataFrame:
    """(candidate, logit): a network over nodes, edges and one cell for each candidate, with given weights. nodes: (candidate, node, v), edges: (candidate, edge, src, dst, e array of 3, face: 1 where the edge bounds the cell, else 0), cells: (candidate, length).

    An edge reads itself, its ends and the cell; the cell reads its edges; the logit is read from the cell and the mean edge.
    """
    hidden = w["src"].shape[0]
    hv = nodes.select(key, "node", dense([F.col("v")], w["node"], w["node_b"], F.tanh).alias("hv"))
    end = lambda c: hv.select(key, F.col("node").alias(c), F.col("hv").alias(f"h_{c}"))
    face = cells.select(key, dense([F.col("length").cast("double")], w["face"], w["face_b"], F.tanh).alias("f0"))
    met = edges.join(end("src"), [key, "src"]).join(end("dst"), [key, "dst"]).join(face, key)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    ends = F.when(F.col("src") == F.col("dst"), F.transform("h_src", lambda x: x * 0)).otherwise(add(F.col("h_src"), F.col("h_dst")))  # a loop has no column in B1
    low = add(ends, add(dense(F.col("h_src"), w["src"]), dense(F.col("h_dst"), w["dst"])))
    parts = F.concat(dense(F.col("e"), w["edge"], w["edge_b"], F.tanh), low, F.transform("f0", lambda x: x * F.col("face")))
    he = met.select(key, "face", "f0", dense(parts, w["eu"], w["eu_b"], F.tanh).alias("he"))
    each = he.groupBy(key).agg(F.first("f0").alias("f0"), F.array(*(F.avg(F.get("he", F.lit(i))) for i in range(hidden))).alias("mean"), F.array(*(F.sum(F.get("he", F.lit(i)) * F.col("face")) for i in range(hidden))).alias("up"))
    hf = dense(F.concat("f0", "up"), w["fu"], w["fu_b"], F.tanh)
    return each.select(key, F.get(dense(add(hf, F.col("mean")), w["out"], w["out_b"]), F.lit(0)).alias("logit"))


def directed_network(nodes: DataFrame, edges: DataFrame, cells: DataFrame, w: dict[str, np.ndarray], key: str = "candidate") -> DataFrame:
    """(candidate, logit): a network that passes messages along and against each edge, with given weights. nodes: (candidate, node, v: 1 on the cycle, else 0), edges: (candidate, edge, src, dst, e array of 3, chosen: 1 or 0), cells: (candidate, length). The logit is read from the cycle's nodes, the chosen edges and the length."""
    hidden = w["n"].shape[1]
    h = nodes.select(key, "node", "v", dense([F.col("v")], w["n"], w["n_b"], F.tanh).alias("h"))
    end = lambda x, c: x.select(key, F.col("node").alias(c), F.col("h").alias(f"h_{c}"))
    met = edges.join(end(h, "src"), [key, "src"]).join(end(h, "dst"), [key, "dst"])
    total = lambda x, c, name: summed(met.select(key, c, dense(F.concat(x, F.col("e")), w[name], w[f"{name}_b"], F.tanh).alias("x")), [key], c, "x", hidden)
    out, into = total(F.col("h_dst"), "src", "om").withColumnRenamed("m", "out"), total(F.col("h_src"), "dst", "im").withColumnRenamed("m", "in")
    none = F.array(*(F.lit(0.0) for _ in range(hidden)))
    second = h.join(out, [key, "node"], "left").join(into, [key, "node"], "left").select(key, "node", "v", dense(F.concat("h", F.coalesce("in", none), F.coalesce("out", none)), w["up"], w["up_b"], F.tanh).alias("h"))
    share = lambda df, x, by, name: df.groupBy(key).agg(F.array(*(F.sum(F.get(x, F.lit(i)) * F.col(by)) / (F.sum(by) + 1e-6) for i in range(hidden))).alias(name))
    read = edges.join(end(second, "src"), [key, "src"]).select(key, "chosen", dense(F.concat("h_src", F.col("e")), w["er"], w["er_b"], F.tanh).alias("x"))
    both = cells.join(share(second, "h", "v", "nr"), key).join(share(read, "x", "chosen", "er"), key)
    return both.select(key, F.get(dense(F.concat("nr", "er", F.array(F.col("length").cast("double"))), w["read"], w["read_b"]), F.lit(0)).alias("logit"))


def simplicial_network(nodes: DataFrame, edges: DataFrame, faces: DataFrame, sides: DataFrame, w: dict[str, np.ndarray], key: str = "candidate") -> DataFrame:
    """(candidate, logit): a network over nodes, edges and triangles, with given weights. nodes: (candidate, node, v array), edges: (candidate, edge, src, dst, e array), faces: (candidate, face, f), sides: (candidate, face, edge). Edges read their ends, nodes and triangles read their edges; the logit is read from the means of both."""
    hidden = w["v"].shape[1]
    hv = nodes.select(key, "node", dense(F.col("v"), w["v"], w["v_b"], F.tanh).alias("h"))
    end = lambda c: hv.select(key, F.col("node").alias(c), F.col("h").alias(f"h_{c}"))
    met = edges.join(end("src"), [key, "src"]).join(end("dst"), [key, "dst"])
    ends = F.when(F.col("src") == F.col("dst"), F.transform("h_src", lambda x: x * 0)).otherwise(F.zip_with("h_src", "h_dst", lambda x, y: x + y))
    he = met.select(key, "edge", "src", "dst", dense(F.concat(dense(F.col("e"), w["rel"], w["rel_b"], F.tanh), ends), w["e"], w["e_b"], F.tanh).alias("he"))
    none = F.array(*(F.lit(0.0) for _ in range(hidden)))
    around = summed(he.where("src <> dst").select(key, "he", F.explode(F.array("src", "dst")).alias("at")), [key], "at", "he", hidden)
    hv2 = hv.join(around, [key, "node"], "left").select(key, dense(F.concat("h", F.coalesce("m", none)), w["vu"], w["vu_b"], F.tanh).alias("x"))
    up = summed(sides.join(he.select(key, "edge", "he"), [key, "edge"]), [key], "face", "he", hidden).withColumnRenamed("node", "face")
    hf = faces.join(up, [key, "face"], "left").select(key, dense(F.concat(dense([F.col("f")], w["f"], w["f_b"], F.tanh), F.coalesce("m", none)), w["fu"], w["fu_b"], F.tanh).alias("x"))
    mean = lambda df, name: df.groupBy(key).agg(F.array(*(F.avg(F.get("x", F.lit(i))) for i in range(hidden))).alias(name))
    both = mean(hv2, "a").join(mean(hf, "b"), key)
    return both.select(key, F.get(dense(F.zip_with("a", "b", lambda x, y: x + y), w["out"], w["out_b"]), F.lit(0)).alias("logit"))


def parameters(layers: dict[str, np.ndarray]) -> int:
    """The numbers that a network's layers hold."""
    return sum(int(np.asarray(w).size) for w in layers.values())


def parity(counts: DataFrame, by: list[str], tolerance: float = 0.02) -> DataFrame:
    """counts (by, model, parameters) with mean, deviation (of each model from the mean, as a share of it), most (the largest deviation) and even: whether that is within the tolerance. A group without parameters raises."""
    stats = counts.groupBy(*by).agg(F.avg("parameters").alias("mean"), F.max("parameters").alias("_high"), F.min("parameters").alias("_low"))
    stats = stats.withColumn("mean", F.when(F.col("mean") > 0, F.col("mean")).otherwise(F.raise_error(F.lit("models without parameters")).cast("double")))
    met = counts.join(stats, by) if by else counts.join(F.broadcast(stats))
    most = F.greatest(F.col("_high") - F.col("mean"), F.col("mean") - F.col("_low")) / F.col("mean")
    return met.select(*counts.columns, "mean", (F.abs(F.col("parameters") - F.col("mean")) / F.col("mean")).alias("deviation"), most.alias("most"), (most <= tolerance).alias("even"))


def moved(score, nodes: DataFrame, edges: DataFrame, cells: DataFrame, key: str = "candidate", salt: str = "order", tolerance: float = 1e-9) -> DataFrame:
    """(key, change) of the candidates whose logit changes when nodes and edges get other names and rows another order, which must change nothing. score(nodes, edges, cells) gives (key, logit)."""
    other = lambda c: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(salt), F.col(c).cast("string"))), 1, 15), 16, 10).cast("bigint")
    renamed = nodes.withColumn("node", other("node")).repartition(3), edges.withColumns({c: other(c) for c in ("src", "dst", "edge")}).repartition(5), cells.repartition(2)
    both = score(nodes, edges, cells).join(score(*renamed).withColumnRenamed("logit", "_other"), key, "full")
    change = F.abs(F.col("logit") - F.col("_other"))
    return both.select(key, change.alias("change")).where(F.coalesce(change > tolerance, F.lit(True)))


def channels(df: DataFrame, names: list[str], score, by: str, shift: float = 1.0) -> DataFrame:
    """(channel, moved): for each predictor, how many rows' scores move when it alone is shifted: a channel that moves none doesn't reach the model. score(df, names) gives df with `logit`."""
    base = score(df, names).select(by, F.col("logit").alias("_base"))
    found = []
    for c in names:
        other = score(df.withColumn(c, F.col(c) + shift), names).select(by, "logit")
        found.append(base.join(other, by).agg(F.lit(c).alias("channel"), F.count_if(F.abs(F.col("logit") - F.col("_base")) > 1e-9).alias("moved")))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out
