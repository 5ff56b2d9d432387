"""Presentation and label linkbases: one ordered, depth-tagged row set per statement role."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon import schemas as S
from tabulon.functions import scalars as X
from tabulon.sources.scratch import written

ROLE_TYPES = "array<struct<_roleURI: string, definition: string>>"


def _xml(raw: DataFrame, schema: str, path: str) -> DataFrame:
    text = F.decode("content", "UTF-8")
    read = F.from_xml(text, schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE"})
    return raw.select("accession", F.posexplode(read[path]).alias("link", "x"))


def _concepts(links: DataFrame) -> DataFrame:
    """Last concept of each locator of a link."""
    locs = links.select("accession", "link", F.posexplode("x.loc").alias("at", "l"))
    return locs.groupBy("accession", "link", F.col("l._label").alias("label")).agg(X.concept_of_href(F.max_by("l._href", "at")).alias("concept"), F.min("at").alias("at"))


def role_titles(raw: DataFrame) -> DataFrame:
    """accession, role_uri and title of a schema's role types: what follows the last ' - '."""
    d = raw.select("accession", F.from_xml(F.decode("content", "UTF-8"), S.SCHEMA_XML, {"ignoreNamespace": "true"}).alias("x"))
    # annotations and their parts may stand more than once
    kinds = F.flatten(F.transform("x.annotation", lambda a: F.flatten(F.transform(a["appinfo"], lambda i: F.coalesce(i["roleType"], F.array().cast(ROLE_TYPES))))))
    d = d.select("accession", F.posexplode(kinds).alias("at", "r"))
    title = X.trim(F.substring_index(X.trim("r.definition"), " - ", -1))
    d = d.select("accession", F.col("r._roleURI").alias("role_uri"), title.alias("title"), "at").filter("title <> ''")
    return d.groupBy("accession", "role_uri").agg(F.max_by("title", "at").alias("title"))


def labels(raw: DataFrame) -> DataFrame:
    """accession, concept, label_role and text; of several the last stands."""
    links = _xml(raw, S.LABEL_XML, "labelLink")
    arcs = links.select("accession", "link", F.posexplode("x.labelArc").alias("at", "a")).select("accession", "link", "at", F.col("a._from").alias("label"), F.col("a._to").alias("resource"))
    named = arcs.join(_concepts(links).drop("at"), ["accession", "link", "label"])
    named = named.groupBy("accession", "link", "resource").agg(F.max_by("concept", "at").alias("concept"))
    texts = links.select("accession", "link", F.posexplode("x.label").alias("at", "l")).select("accession", "link", "at", F.col("l._label").alias("resource"), F.col("l._role").alias("label_role"), X.trim("l._VALUE").alias("text"))
    d = texts.join(named, ["accession", "link", "resource"])
    return d.groupBy("accession", "concept", "label_role").agg(F.max_by(F.coalesce("text", F.lit("")), F.struct("link", "at")).alias("text"))


def label_of(texts: Column, preferred: Column, concept: Column) -> Column:
    """The text of the preferred role, else standard, terse, verbose, else of the least role that
    has one, else the concept's name in words. ``texts`` maps roles to texts."""
    told = lambda role: F.when(F.try_element_at(texts, role) != "", F.try_element_at(texts, role))
    filled = F.map_filter(texts, lambda _, v: v != "")
    first = F.try_element_at(filled, F.array_min(F.map_keys(filled)))
    preferred = F.coalesce(preferred, F.lit(""))
    return F.coalesce(F.when(preferred != "", told(preferred)), *(told(F.lit(r)) for r in (S.LABEL, S.TERSE, S.VERBOSE)), first, X.humanize(concept))


def walk_tree(edges: DataFrame, roots: DataFrame, keys: list[str], levels: int | None = None) -> DataFrame:
    """keys, node, depth and path of every node that roots reach, each on its first visit.

    edges(keys, parent, child, rank), roots(keys, node, rank); path is the ranks from the root on,
    so sorting by it is depth-first order. A level is a join; only nodes that grew a level are
    joined again, and a node on its own path isn't followed, so it ends. Trees deeper than ``levels`` raise, if
    it is given.
    """
    front = roots.select(*keys, "node", F.lit(0).alias("depth"), F.array("rank").alias("path"), F.array("node").alias("line"))
    found = [front]
    for depth in count(1):
        if levels is not None and depth > levels:
            raise ValueError(f"a tree has more than {levels} levels")
        e = edges.withColumnRenamed("parent", "node")
        front = front.join(e, [*keys, "node"]).filter(~F.array_contains("line", F.col("child")))
        front = front.select(*keys, F.col("child").alias("node"), F.lit(depth).alias("depth"), F.concat("path", F.array("rank")).alias("path"), F.concat("line", F.array("child")).alias("line"))
        front = written(front, "level")
        if front.isEmpty():
            break
        found.append(front)
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    first = out.groupBy(*keys, "node").agg(F.min("path").alias("path"))
    return out.join(first, [*keys, "node", "path"], "left_semi").select(*keys, "node", "depth", "path")


def roles(presentation: DataFrame, label_texts: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """accession, role_seq, role_uri, title, path, name, label, preferred_label, depth,
    has_children and structural: the concepts of every role in depth-first order of ``path``.

    The last arc into a locator gives its preferred label; siblings come by order, then as
    written; roots are locators that no arc enters, as written. Repeated visits don't count.
    """
    links = _xml(presentation, S.PRESENTATION_XML, "presentationLink")
    concepts = _concepts(links)
    arcs = links.select("accession", "link", F.posexplode("x.presentationArc").alias("at", "a")).select("accession", "link", "at", F.col("a._from").alias("parent"), F.col("a._to").alias("child"), F.col("a._order").alias("order"), F.col("a._preferredLabel").alias("preferred"))
    keys = ["accession", "link"]
    rank = lambda order, at: F.struct(F.coalesce(order, F.lit(0.0)).alias("order"), at.cast("long").alias("at"))
    roots = concepts.join(arcs.select(*keys, F.col("child").alias("label")), [*keys, "label"], "left_anti").select(*keys, F.col("label").alias("node"), rank(F.lit(0.0), F.col("at")).alias("rank"))
    edges = arcs.select(*keys, "parent", "child", rank(F.col("order"), F.col("at")).alias("rank"))
    tree = walk_tree(written(edges, "edges"), written(roots, "roots"), keys)
    preferred = arcs.groupBy(*keys, F.col("child").alias("node")).agg(F.max_by(F.coalesce("preferred", F.lit("")), "at").alias("preferred_label"))
    parents = arcs.select(*keys, F.col("parent").alias("node"), F.lit(True).alias("has_children")).distinct()
    texts = label_texts.groupBy("accession", "concept").agg(F.map_from_entries(F.collect_list(F.struct("label_role", "text"))).alias("texts"))
    d = tree.join(concepts.select(*keys, F.col("label").alias("node"), "concept"), [*keys, "node"], "left").join(preferred, [*keys, "node"], "left").join(parents, [*keys, "node"], "left")
    d = d.join(texts, ["accession", "concept"], "left").join(links.select(*keys, F.col("x._role").alias("role_uri")), keys)
    tail = F.substring_index("role_uri", "/", -1)
    if titles is None:
        d = d.withColumn("title", tail)
    else:
        d = d.join(titles, ["accession", "role_uri"], "left").withColumn("title", F.coalesce("title", tail))
    name = F.coalesce("concept", F.lit(""))
    return d.select(
        "accession", F.col("link").alias("role_seq"), "role_uri", "title", "path", name.alias("name"), label_of(F.coalesce("texts", F.create_map().cast("map<string,string>")), F.col("preferred_label"), name).alias("label"),
        F.coalesce("preferred_label", F.lit("")).alias("preferred_label"), "depth", F.coalesce("has_children", F.lit(False)).alias("has_children"), X.is_structural(name).alias("structural"),
    )


def select_roles(role_rows: DataFrame, statements: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """accession, statement and role_seq: for each statement the first role whose folded address
    contains one of its keywords and nothing that marks details."""
    wanted = statements or S.STATEMENTS
    words = role_rows.sparkSession.createDataFrame([(s, k) for s, keys in wanted.items() for k in keys], "statement string, keyword string")
    uris = role_rows.select("accession", "role_seq", X.fold_role(F.col("role_uri")).alias("folded")).distinct().filter(~F.col("folded").rlike(S.NOT_STATEMENTS))
    # the keywords are a dozen rows whatever the input
    hits = uris.join(F.broadcast(words), F.contains("folded", "keyword"))
    return hits.groupBy("accession", "statement").agg(F.min("role_seq").alias("role_seq"))
