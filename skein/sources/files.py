"""Graphs and grids in files: Parquet, edge lists, NCOL, adjacency lists, GraphML, GML, Pajek, LGL, DIMACS, DOT, text."""

from __future__ import annotations

import gzip
import html
import re
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..operators.spatial import link_distances
from ..plans.blocks import durable, ensure_workers, positions


def save_parquet(g: Graph, path: str) -> None:
    g.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
    g.edges.withColumn("_directed", F.lit(g.directed)).write.mode("overwrite").parquet(f"{path}/edges")


def load_parquet(spark: SparkSession, path: str) -> Graph:
    e = spark.read.parquet(f"{path}/edges")
    first = e.select("_directed").first()
    return Graph(spark.read.parquet(f"{path}/nodes"), e.drop("_directed"), bool(first and first[0]))


def _once(g: Graph) -> DataFrame:
    return g.edges if g.directed else g.edges.filter("src < dst")


def save_edge_list(g: Graph, path: str, attribute: str | None = None) -> None:
    """``src dst`` a line; with an attribute NCOL's ``src dst weight``."""
    cols = ["src", "dst", *([attribute] if attribute else [])]
    _once(g).select(F.concat_ws(" ", *[F.col(c).cast("string") for c in cols]).alias("value")).write.mode("overwrite").text(path)


def load_edge_list(spark: SparkSession, path: str, directed: bool = False, attribute: str | None = None) -> Graph:
    """Two or, with an attribute, three columns parted by white space; ``#`` lines are comments."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).filter("trim(value) != '' and not trim(value) like '#%'")
    cols = [parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")]
    if attribute:
        cols.append(parts[2].cast("double").alias(attribute))
    return Graph.of(rows.select(*cols), None, directed)


def save_adjacency_lists(g: Graph, path: str) -> None:
    """``node: neighbour ...`` a line."""
    lists = g.nodes.select(F.col("id").alias("src")).join(g.edges.select("src", "dst"), "src", "left").groupBy("src").agg(F.sort_array(F.collect_list("dst")).alias("n"))
    lists.select(F.concat(F.col("src").cast("string"), F.lit(": "), F.concat_ws(" ", F.transform("n", lambda x: x.cast("string")))).alias("value")).write.mode("overwrite").text(path)


def load_adjacency_lists(spark: SparkSession, path: str, directed: bool = False) -> Graph:
    """``node: neighbour ...`` (or parted by white space only) a line; nodes without neighbours stay."""
    t = spark.read.text(path).filter("trim(value) != '' and not trim(value) like '#%'")
    parts = t.select(F.split(F.trim(F.translate("value", ":", " ")), r"\s+").alias("p")).select(F.transform("p", lambda x: x.cast("long")).alias("p"))
    e = parts.select(F.get("p", F.lit(0)).alias("src"), F.explode(F.slice("p", 2, 1 << 30)).alias("dst"))
    nodes = parts.select(F.explode("p").alias("id")).distinct()
    return Graph.of(e, nodes, directed)


# formats whose elements depend on what came before: one task reads or writes a file ------------------


def _named(columns: list[str], own: tuple[str, ...]) -> list[str]:
    return [c for c in columns if c not in own]


def graph_text(g: Graph, kind: str) -> DataFrame:
    """``part, value``: the lines of a GraphML, GML, Pajek, LGL, DIMACS or DOT file, to be written in order of part (header, nodes, links, footer).

    GraphML, GML and DOT keep all attributes of nodes and links (numbers and strings),
    Pajek and LGL the link attribute ``weight`` if there is one, DIMACS none. Pajek and
    DIMACS number nodes from 1.
    """
    spark = g.nodes.sparkSession
    n, e = g.nodes, _once(g)
    s = lambda c: F.col(c).cast("string")
    text = lambda c, kinds: kinds[c] == "string"
    nk, ek = dict(n.dtypes), dict(e.dtypes)
    na, ea = _named(n.columns, ("id",)), _named(e.columns, ("src", "dst"))
    join = lambda parts: F.concat(*parts) if len(parts) > 1 else parts[0]
    if kind == "graphml":
        xml = lambda c, kinds: F.replace(F.replace(F.replace(s(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")) if text(c, kinds) else s(c)
        key = lambda c, kinds, of: f'<key id="{of[0]}_{escape(c)}" for="{of}" attr.name="{escape(c)}" attr.type="{"string" if text(c, kinds) else "double"}"/>'
        head = ['<?xml version="1.0" encoding="UTF-8"?>', '<graphml xmlns="http://graphml.graphdrawing.org/xmlns">', *[key(c, nk, "node") for c in na], *[key(c, ek, "edge") for c in ea], f'<graph edgedefault="{"directed" if g.directed else "undirected"}">']
        data = lambda c, kinds, of: F.when(F.col(c).isNotNull(), F.concat(F.lit(f'<data key="{of}_{escape(c)}">'), xml(c, kinds), F.lit("</data>"))).otherwise("")
        nodes = join([F.lit('<node id="n'), s("id"), F.lit('">'), *[data(c, nk, "n") for c in na], F.lit("</node>")])
        links = join([F.lit('<edge source="n'), s("src"), F.lit('" target="n'), s("dst"), F.lit('">'), *[data(c, ek, "e") for c in ea], F.lit("</edge>")])
        rows = [(0, head), (1, nodes), (2, links), (3, ["</graph>", "</graphml>"])]
    elif kind == "gml":
        quoted = lambda c, kinds: F.concat(F.lit('"'), F.replace(s(c), F.lit('"'), F.lit("&quot;")), F.lit('"')) if text(c, kinds) else s(c)
        field = lambda c, kinds: F.when(F.col(c).isNotNull(), F.concat(F.lit(f" {c} "), quoted(c, kinds))).otherwise("")
        nodes = join([F.lit("  node [ id "), s("id"), *[field(c, nk) for c in na], F.lit(" ]")])
        links = join([F.lit("  edge [ source "), s("src"), F.lit(" target "), s("dst"), *[field(c, ek) for c in ea], F.lit(" ]")])
        rows = [(0, ["graph [", f"  directed {int(g.directed)}"]), (1, nodes), (2, links), (3, ["]"])]
    elif kind == "pajek":
        w = [F.lit(" "), F.coalesce(s("weight"), F.lit("1"))] if "weight" in ea else []
        placed = positions(n.select("id"), ["id"])
        nodes = placed.select(F.lit(1).alias("part"), F.concat((F.col("pos") + 1).cast("string"), F.lit(' "'), s("id"), F.lit('"')).alias("value"))
        at = placed.select("id", F.col("pos") + 1)
        e2 = e.join(at.toDF("src", "_a"), "src").join(at.toDF("dst", "_b"), "dst")
        links = e2.select(F.lit(3).alias("part"), join([s("_a"), F.lit(" "), s("_b"), *w]).alias("value"))
        return spark.createDataFrame([(0, f"*Vertices {n.count()}"), (2, "*Arcs" if g.directed else "*Edges")], "part int, value string").union(nodes).union(links)
    elif kind == "lgl":
        w = [F.lit(" "), F.coalesce(s("weight"), F.lit("1"))] if "weight" in ea else []
        near = e.groupBy("src").agg(F.sort_array(F.collect_list(join([s("dst"), *w]))).alias("l"))
        body = n.select(F.col("id").alias("src")).join(near, "src", "left").select(F.lit(1).alias("part"), F.concat(F.lit("# "), s("src"), F.when(F.size("l") > 0, F.concat(F.lit("\n"), F.array_join("l", "\n"))).otherwise("")).alias("value"))
        return body
    elif kind == "dimacs":
        rows = [(0, [f"p edge {n.agg(F.max('id')).first()[0] + 1 if not n.isEmpty() else 0} {e.count()}"]), (2, F.concat(F.lit("e "), (F.col("src") + 1).cast("string"), F.lit(" "), (F.col("dst") + 1).cast("string")))]
    elif kind == "dot":
        arrow = " -> " if g.directed else " -- "
        quoted = lambda c, kinds: F.concat(F.lit(f'{c}="'), F.replace(s(c), F.lit('"'), F.lit("'")), F.lit('"'))
        fields = lambda cols, kinds: F.concat(F.lit(" ["), F.concat_ws(", ", *[F.when(F.col(c).isNotNull(), quoted(c, kinds)) for c in cols]), F.lit("]")) if cols else F.lit("")
        rows = [(0, ["digraph {" if g.directed else "graph {"]), (1, F.concat(F.lit("  "), s("id"), fields(na, nk), F.lit(";"))), (2, F.concat(F.lit("  "), s("src"), F.lit(arrow), s("dst"), fields(ea, ek), F.lit(";"))), (3, ["}"])]
    else:
        raise ValueError(f"unknown format {kind}")
    out = None
    for part, value in rows:
        if isinstance(value, list):
            one = spark.createDataFrame([(part, "\n".join(value))], "part int, value string")
        else:
            one = (n if part == 1 else e).select(F.lit(part), value.alias("value"))
        out = one if out is None else out.union(one)
    return out


def save_text(g: Graph, path: str, kind: str) -> None:
    """The format's parts as text files that, read in order of name, are the whole file."""
    lines = graph_text(g, kind)
    lines.repartitionByRange(8, "part").sortWithinPartitions("part").select("value").write.mode("overwrite").text(path)


def _graphml(text: str):
    import xml.etree.ElementTree as ET

    root = ET.fromstring(text)
    tag = lambda x: x.tag.rsplit("}", 1)[-1]
    keys = {k.get("id"): (k.get("attr.name") or k.get("id"), k.get("attr.type") or "string") for k in root.iter() if tag(k) == "key"}
    types = {name: kind for name, kind in keys.values()}

    def data(x):
        return {keys.get(d.get("key"), (d.get("key"), "string"))[0]: d.text or "" for d in x if tag(d) == "data"}

    for x in root.iter():
        if tag(x) == "graph":
            yield "graph", str(x.get("edgedefault") == "directed"), None, {}
        elif tag(x) == "node":
            yield "node", x.get("id"), None, data(x)
        elif tag(x) == "edge":
            yield "edge", x.get("source"), x.get("target"), data(x)
    yield "types", None, None, {k: ("string" if v == "string" else "double") for k, v in types.items()}


def _gml(text: str):
    tokens = re.findall(r'"[^"]*"|\[|\]|[^\s\[\]]+', re.sub(r"(?m)^\s*#.*$", "", text))

    def block(at: int):
        out = []
        while at < len(tokens) and tokens[at] != "]":
            key = tokens[at]
            if at + 1 < len(tokens) and tokens[at + 1] == "[":
                value, at = block(at + 2)
            else:
                value, at = tokens[at + 1] if at + 1 < len(tokens) else "", at + 2
            out.append((key.lower(), value))
        return out, at + 1

    def plain(x: str) -> str:
        return html.unescape(x[1:-1]) if x[:1] == '"' else x

    top, _ = block(0)
    types: dict[str, str] = {}
    for key, value in top:
        if key != "graph":
            continue
        yield "graph", str(dict((k, v) for k, v in value if isinstance(v, str)).get("directed") == "1"), None, {}
        for kind, body in value:
            if kind in ("node", "edge") and isinstance(body, list):
                flat = {k: v for k, v in body if isinstance(v, str)}
                types.update({k: "string" for k, v in flat.items() if v[:1] == '"'})
                flat = {k: plain(v) for k, v in flat.items()}
                ends = (flat.pop("id", None), None) if kind == "node" else (flat.pop("source", None), flat.pop("target", None))
                yield kind, *ends, flat
    yield "types", None, None, types


def _pajek(text: str):
    mode, row = "", 0
    directed = False
    for line in text.splitlines():
        line = line.strip()
        if not line or line[0] == "%":
            continue
        if line[0] == "*":
            word = line.split()
            mode, row = word[0][1:].lower(), 0
            directed |= mode in ("arcs", "arcslist", "matrix")
            if mode == "vertices":
                for k in range(int(word[1])):
                    yield "node", str(k), None, {}
            continue
        part = re.findall(r'"[^"]*"|\S+', line)
        if mode == "vertices":
            if len(part) > 1:
                yield "node", str(int(part[0]) - 1), None, {"label": part[1].strip('"')}
        elif mode in ("arcs", "edges"):
            ends = str(int(part[0]) - 1), str(int(part[1]) - 1)
            more = {"weight": part[2]} if len(part) > 2 else {}
            yield "edge", *ends, more
            if mode == "edges":
                yield "edge", ends[1], ends[0], more
        elif mode in ("arcslist", "edgeslist"):
            for other in part[1:]:
                yield "edge", str(int(part[0]) - 1), str(int(other) - 1), {}
                if mode == "edgeslist":
                    yield "edge", str(int(other) - 1), str(int(part[0]) - 1), {}
        elif mode == "matrix":
            for k, v in enumerate(part):
                if float(v):
                    yield "edge", str(row), str(k), {"weight": v}
            row += 1
    yield "graph", str(directed), None, {}
    yield "types", None, None, {"label": "string"}


def _lgl(text: str):
    node = None
    for line in text.splitlines():
        part = line.split()
        if part and part[0] == "#":
            node = part[1]
            yield "node", node, None, {}
        elif part and node is not None:
            yield "edge", node, part[0], {"weight": part[1]} if len(part) > 1 else {}
    yield "graph", "False", None, {}


def _dimacs(text: str):
    directed = False
    for line in text.splitlines():
        part = line.split()
        if part[:1] == ["p"]:
            for k in range(int(part[2])):
                yield "node", str(k), None, {}
        elif part[:1] in (["e"], ["a"]):
            directed |= part[0] == "a"
            yield "edge", str(int(part[1]) - 1), str(int(part[2]) - 1), {"weight": part[3]} if len(part) > 3 else {}
    yield "graph", str(directed), None, {}


def _dot(text: str):
    text = re.sub(r"/\*.*?\*/|//[^\n]*|(?m:^\s*#[^\n]*)", "", text, flags=re.S)
    yield "graph", str(re.match(r"\s*(strict\s+)?digraph\b", text) is not None), None, {}
    body = text[text.index("{") + 1 : text.rindex("}")]
    name = r'(?:"[^"]*"|[\w.]+)'
    types: dict[str, str] = {}
    for m in re.finditer(rf"({name}(?:\s*(?:--|->)\s*{name})*)\s*(?:\[([^\]]*)\])?\s*(?:;|\n|$)", body):
        chain = [x.strip().strip('"') for x in re.split(r"\s*(?:--|->)\s*", m[1])]
        if len(chain) == 1 and chain[0] in ("node", "edge", "graph", "strict"):
            continue
        more = {k: v.strip('"') for k, v in re.findall(rf"(\w+)\s*=\s*({name}|-?[\d.eE+-]+)", m[2] or "")}
        if len(chain) == 1:
            yield "node", chain[0], None, more
        for a, b in zip(chain, chain[1:], strict=False):
            yield "edge", a, b, more
    yield "types", None, None, types


PARSERS = {"graphml": _graphml, "graphmlz": _graphml, "gml": _gml, "pajek": _pajek, "net": _pajek, "lgl": _lgl, "dimacs": _dimacs, "dot": _dot}


def load_text(spark: SparkSession, path: str, kind: str) -> Graph:
    """A GraphML, GML, Pajek, LGL, DIMACS or DOT file, or a folder of its parts in order of name; gzipped ones too.

    Attributes of nodes and links become columns, numbers as doubles. Node ids that
    are whole numbers, with or without one letter before them, keep them; others are
    numbered in the file's order, with the name in ``name``. Nodes that only links
    mention exist too; the weight of a node without attribute ``w`` is 1. Repeated
    links count once. A file without elements of the format raises. One task reads a
    file (2 GB at most, the reader's limit).
    """
    if kind not in PARSERS:
        raise ValueError(f"unknown format {kind}")
    ensure_workers(spark)
    parse = PARSERS[kind]
    raw = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.lit(0).alias("k"), "path", "content")

    def run(x: pd.DataFrame) -> pd.DataFrame:
        parts = [gzip.decompress(c) if c[:2] == b"\x1f\x8b" else bytes(c) for c in x.sort_values("path").content]
        rows = [(n, *r) for n, r in enumerate(parse(b"".join(parts).decode("utf-8-sig")))]
        return pd.DataFrame(rows, columns=["n", "kind", "a", "b", "more"])

    table = durable(raw.groupBy("k").applyInPandas(run, "n long, kind string, a string, b string, more map<string,string>"), "graphfile")
    heads = {r.kind: r for r in table.filter("kind in ('graph', 'types')").collect()}
    if "graph" not in heads:
        raise ValueError(f"no {kind} graph in {path}")
    given = dict(heads["types"].more) if "types" in heads else {}
    names = table.filter("kind = 'node'").select("n", F.col("a").alias("name")).union(table.filter("kind = 'edge'").select("n", F.explode(F.array("a", "b")).alias("name"))).filter("name is not null").groupBy("name").agg(F.min("n").alias("n"))
    numbered = names.withColumn("id", F.expr("try_cast(regexp_extract(name, '^[A-Za-z]?([0-9]+)$', 1) as bigint)"))
    clash = numbered.agg(F.count("*").alias("n"), F.countDistinct("id").alias("d")).first()
    if clash.n != clash.d:
        numbered = positions(names, ["n", "name"]).withColumnRenamed("pos", "id")
    ids = durable(numbered.select("id", "name"), "ids")

    def columns(kind_: str) -> list:
        keys = sorted(r.k for r in table.filter(F.col("kind") == kind_).select(F.explode(F.map_keys("more")).alias("k")).distinct().collect())
        return [(F.col("more")[k] if given.get(k) == "string" else F.expr(f"try_cast(more['{k}'] as double)") if k in given or k in ("w", "weight") or _numeric(k) else F.col("more")[k]).alias(k) for k in keys if k not in ("id", "src", "dst", "name")]

    def _numeric(k: str) -> bool:
        return table.filter(F.col("more")[k].isNotNull() & F.expr(f"try_cast(more['{k}'] as double)").isNull()).isEmpty()

    own = table.filter("kind = 'node'").groupBy("a").agg(F.max_by("more", F.struct(F.size("more"), "n")).alias("more")).withColumnRenamed("a", "name")
    nodes = ids.join(own, "name", "left").select("id", "name", *columns("node"))
    links = table.filter("kind = 'edge'").select("a", "b", *columns("edge"))
    e = links.join(ids.toDF("src", "a"), "a").join(ids.toDF("dst", "b"), "b").drop("a", "b")
    w = F.coalesce("w", F.lit(1.0)) if "w" in nodes.columns else F.lit(1.0)
    return Graph.of(e, nodes.withColumn("w", w.cast("double")), heads["graph"].a == "True")


# graphs in space ----------------------------------------------------------------------------------


def save_spatial(g: Graph, grid: DataFrame, path: str, similarity: DataFrame | None = None) -> None:
    """Graph, grid and, of a network of similarities, their table, as Parquet."""
    save_parquet(g, path)
    grid.write.mode("overwrite").parquet(f"{path}/grid")
    if similarity is not None:
        similarity.write.mode("overwrite").parquet(f"{path}/similarity")


def load_spatial(spark: SparkSession, path: str) -> tuple[Graph, DataFrame]:
    return load_parquet(spark, path), spark.read.parquet(f"{path}/grid")


def load_similarity(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/similarity")


def save_for_viewer(g: Graph, grid: DataFrame, path: str, kind: str = "graphml") -> None:
    """GraphML or DOT with ``lat`` and ``lon`` at the nodes and ``ang_dist`` at the links."""
    nodes = g.nodes.join(grid.select(F.col("node").alias("id"), "lat", "lon"), "id")
    links = g.edges.join(link_distances(g, grid).withColumnRenamed("d", "ang_dist"), ["src", "dst"])
    save_text(Graph(nodes, links, g.directed), path, kind)


def save_grid_text(grid: DataFrame, times: DataFrame, path: str) -> None:
    """Three text files of numbers, one a line: ``lat`` and ``lon`` in order of node, ``time`` in order."""
    for name, df in (("lat", grid.select("node", "lat")), ("lon", grid.select("node", "lon")), ("time", times.select(F.col("t").alias("node"), F.col("t")))):
        df.repartitionByRange("node").sortWithinPartitions("node").select(F.col(df.columns[1]).cast("string").alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def load_grid_text(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``node, lat, lon`` and ``t`` from the files of :func:`save_grid_text`: a line's place is its node."""

    def numbers(name: str, out: str) -> DataFrame:
        t = spark.read.text(f"{path}/{name}").select("value", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_block_start").alias("o"), F.monotonically_increasing_id().alias("m"))
        return positions(t.filter("trim(value) != ''"), ["f", "o", "m"], "node").select("node", F.col("value").cast("double").alias(out))

    return numbers("lat", "lat").join(numbers("lon", "lon"), "node"), numbers("time", "t").select("t")


def load_series(spark: SparkSession, path: str, node: str = "node", time: str = "t", value: str = "x") -> DataFrame:
    """``node, t, x`` from Parquet."""
    return spark.read.parquet(path).select(F.col(node).alias("node"), F.col(time).alias("t"), F.col(value).cast("double").alias("x"))


def load_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """``node, t, x`` from CSV with a header of that names."""
    return spark.read.csv(path, header=True, schema="node string, t double, x double")
