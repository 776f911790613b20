"""Registered queries of the graph engine over the driver's tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tickets as K
from ..operators import names as N
from ..operators import serving as S
from ..operators import units as U
from ..operators.graph import CodeGraph
from ..operators.walk import callgraph, shared_folder
from ..streaming.fold import fold, read_store, tagged
from . import adapters as A

Q: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        Q[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# SQL that repeats the adapters: tickets, nodes, names and anchors.
def _enc(x: str) -> str:
    return f"url_encode({x})"


def _tick(lang: str, path: str, sig: str) -> str:
    piece = f"'?lang={lang}' || " if lang else ""
    return f"('kythe://testdata' || {piece}'?path=' || replace({_enc(path)}, '%2F', '/')" + (f" || '#' || {_enc(sig)})" if sig else ")")


_PART = _tick("c%2B%2B", "'catalog/' || p_brand || '/' || p_type", "'part#' || p_partkey")
_REGION = _tick("region", "'geo/' || r_name", "'region#' || r_regionkey")
_NATION = _tick("nation", "'geo/' || r_name || '/' || n_name", "'nation#' || n_nationkey")
_CUSTOMER = _tick("customer", "'geo/' || r_name || '/' || n_name || '/customer'", "'customer#' || c_custkey")
_SUPPLIER = _tick("supplier", "'geo/' || r_name || '/' || n_name || '/supplier'", "'supplier#' || s_suppkey")
_GEO = "nation JOIN region ON n_regionkey = r_regionkey"
_NODES = f"""nodes AS (
  SELECT {_REGION} ticket, r_name AS name, 'region' lang FROM region
  UNION ALL SELECT {_NATION}, n_name, 'nation' FROM {_GEO}
  UNION ALL SELECT {_PART}, p_name || '(I)V', 'c++' FROM part
  UNION ALL SELECT {_CUSTOMER}, c_name, 'customer' FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT {_SUPPLIER}, s_name, 'supplier' FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_NAMES = f"""{_NODES}, names AS (
  SELECT DISTINCT name, ticket FROM nodes UNION SELECT replace(name, '(I)V', ''), ticket FROM nodes WHERE lang = 'c++')"""
_LABELS = f"{_NAMES}, labels AS (SELECT ticket, arg_min(name, (strlen(name), name)) AS label FROM names GROUP BY ticket)"
_ORDER_PATH = "'orders/' || o_orderpriority || '/' || o_orderkey"
_ANCHORS = f"""o AS (SELECT * FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_returnflag FROM lineitem)
    JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
  first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM o) WHERE rn = 1),
  anchors AS (
    SELECT {_tick("order", _ORDER_PATH, "l_linenumber || ':' || l_partkey || ':' || l_returnflag")} anchor_ticket, {_tick("", _ORDER_PATH, "")} file_ticket, {_ORDER_PATH} path,
      CAST(l_linenumber AS BIGINT) * 100 start_byte, CASE l_returnflag WHEN 'R' THEN 'ref/call' WHEN 'A' THEN 'ref' ELSE 'ref/call/implicit' END kind, {_PART} target_ticket FROM o
    UNION ALL SELECT {_tick("order", _ORDER_PATH, "'def:' || p_partkey")}, {_tick("", _ORDER_PATH, "")}, {_ORDER_PATH}, CAST(l_linenumber AS BIGINT) * 100 + 60, 'defines/binding', {_PART} FROM first),
  calls AS (SELECT {_SUPPLIER} caller_ticket, {_PART} callee_ticket, 0 ds, at_, 'geo/' || r_name || '/' || n_name || '/supplier' AS caller_path
    FROM (SELECT l_suppkey, l_partkey, min(l_orderkey) AS at_ FROM lineitem GROUP BY ALL) JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  xrefs AS (SELECT target_ticket AS ticket, CASE WHEN kind = 'defines/binding' THEN 'definition' WHEN kind LIKE '%ref/call%' THEN 'call' ELSE 'reference' END AS role, anchor_ticket AS item_ticket, path, start_byte FROM anchors
    UNION ALL SELECT callee_ticket, 'caller', caller_ticket, caller_path, 0 FROM calls)"""


_built: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, key: str, write: Callable[[str], object]) -> str:
    """The folder of what `write` puts there: written to the shared folder once in a session, by the first query that needs it."""
    own = (spark.sparkContext.applicationId, sf_dir, key)
    if own not in _built:
        folder = f"{shared_folder(spark)}/serving-{uuid.uuid4().hex}"  # a failed write is not met again
        write(folder)
        _built[own] = folder
    return _built[own]


def graph(spark: SparkSession, sf_dir: str) -> CodeGraph:
    """The adapter graph. Each serving table, and each part of the cross-references, is written by the first query of a session that needs it."""

    def put(name: str, make: Callable[[], DataFrame], part: str = "") -> DataFrame:
        folder = _stored(spark, sf_dir, part + name, lambda f: S.put(make(), f, name))
        return spark.read.parquet(f"{folder}/{name}")

    def refs(anchors: DataFrame) -> DataFrame:
        return anchors.select("target_ticket", S.role(F.col("kind")).alias("role"), F.col("anchor_ticket").alias("item_ticket"), "file_ticket", "path", "start_byte", "line", "col", "snippet")

    def callers() -> DataFrame:
        zero, caller = F.lit(0).cast("long"), F.col("caller_ticket")
        return t["call_edges"].select(F.col("callee_ticket").alias("target_ticket"), F.lit("caller").alias("role"), caller.alias("item_ticket"), caller.alias("file_ticket"), K.path_of(caller).alias("path"), zero.alias("start_byte"), zero.alias("line"), zero.alias("col"), F.lit("").alias("snippet"))

    parts = {("definition",): lambda: refs(A.definitions(spark, sf_dir)), ("reference", "call"): lambda: refs(A.references(spark, sf_dir)), ("caller",): callers}

    def by_role(roles: tuple[str, ...]) -> DataFrame:
        """Cross-references of the parts that hold these roles."""
        return reduce(DataFrame.unionByName, [put("xrefs", make, f"{own[0]} ") for own, make in parts.items() if set(own) & set(roles)])

    def steps() -> dict[str, DataFrame]:
        return S.steps_of(spark, _stored(spark, sf_dir, "steps", lambda f: S.put_steps(t["call_edges"], f)))

    make = {
        "names": lambda: N.names_of(A.entries(spark, sf_dir)), "labels": lambda: N.labels_of(t["names"]), "edges": lambda: S.edges(A.entries(spark, sf_dir)), "facts": lambda: S.facts(A.entries(spark, sf_dir)),
        "anchors": lambda: A.anchors(spark, sf_dir), "files": lambda: A.document_files(spark, sf_dir).drop("doc_id"), "call_edges": lambda: A.supplier_calls(spark, sf_dir),
        "tree": lambda: S.tree(t["files"].select("corpus", "path")), "first_definitions": lambda: S.first_definitions(by_role(("definition",))), "grams": lambda: N.grams_of(t["names"]), "gram_counts": lambda: N.gram_counts(t["grams"]),
    }
    t = S.Tables({n: partial(put, n, m) for n, m in make.items()} | {"xrefs": lambda: by_role(tuple(r for own in parts for r in own)), "steps": steps})
    return CodeGraph(S.Tables({n: partial(t.__getitem__, n) for n in S.SERVING}), t, True, by_role)


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of conversations as code, as an indexer's output: written once in a session, by the first query that needs them."""
    return spark.read.parquet(_stored(spark, sf_dir, "chat", A.turn_entries(spark, sf_dir).write.parquet))


def event_steps(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The events' calls and the steps of their graph in buckets: written once in a session, by the first query that needs them."""
    folder = _stored(spark, sf_dir, "events", lambda f: S.put_steps(S.put(A.event_calls(spark, sf_dir), f, "call_edges"), f))
    return spark.read.parquet(f"{folder}/call_edges"), S.steps_of(spark, folder)


def first_name(spark: SparkSession, sf_dir: str) -> str:
    return A.table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0] or ""


def _items_sql(roles: str, parts: str = "x.ticket", where: str = "true", limit: int = 50, pick: str = "name = (SELECT min(p_name) FROM part)") -> str:
    return f"""WITH {_LABELS}, {_ANCHORS} SELECT ticket, label, role, item_ticket, path, CAST(0 AS BIGINT) AS line, CAST(0 AS BIGINT) AS col, '' AS snippet, rank FROM (
      SELECT x.ticket, l.label, role, item_ticket, path, row_number() OVER (PARTITION BY {parts} ORDER BY path, start_byte, item_ticket, role) AS rank
      FROM xrefs x JOIN (SELECT DISTINCT ticket FROM names WHERE {pick}) n ON x.ticket = n.ticket LEFT JOIN labels l ON x.ticket = l.ticket WHERE role IN ({roles}) AND {where}) WHERE rank <= {limit}"""


_PATH_SQL = "url_decode(regexp_extract(ticket, '\\?path=([^?#]*)', 1))"


@query("SELECT page_id, url_encode(url) AS escaped, replace(url_encode(url), '%2F', '/') AS escaped_path FROM pages")
def f01_escape(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", K.escape(F.col("url"), False).alias("escaped"), K.escape(F.col("url"), True).alias("escaped_path"))


@query("SELECT doc_id, source || '/' || lang || '/' || doc_id AS cleaned, '/' || source || '/' || doc_id AS rooted FROM documents")
def f02_clean_path(spark, sf_dir):
    d, i = A.table(spark, sf_dir, "documents"), F.col("doc_id").cast("string")
    messy = F.concat(F.lit("./x//../"), "source", F.lit("//."), F.lit("/"), "lang", F.lit("/"), i, F.lit("/"))
    rooted = F.concat(F.lit("/../"), "source", F.lit("/"), "lang", F.lit("/../"), i)
    return d.select("doc_id", K.clean_path(messy).alias("cleaned"), K.clean_path(rooted).alias("rooted"))


@query(f"WITH {_NODES} SELECT ticket, name FROM nodes")
def f03_ticket(spark, sf_dir):
    return A.nodes(spark, sf_dir).select(K.ticket(F.col("source")).alias("ticket"), "name")


@query("SELECT page_id, url AS decoded, 'a%zz+' || url AS lenient FROM pages")
def f04_decode(spark, sf_dir):
    e = K.escape(F.col("url"), False)
    return A.table(spark, sf_dir, "pages").select("page_id", K.decode(e).alias("decoded"), K.decode(F.concat(F.lit("a%zz+"), e)).alias("lenient"))


@query("SELECT p_partkey AS key, 'catalog/' || p_brand || '/' || p_type AS path FROM part")
def f05_path_of(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), K.path_of(K.ticket(A.part_vname())).alias("path"))


@query("SELECT p_partkey AS key, 'part#' || p_partkey AS signature FROM part")
def f06_signature_of(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), K.signature_of(K.ticket(A.part_vname())).alias("signature"))


@query("SELECT p_partkey AS key, p_name AS stripped, CAST(NULL AS VARCHAR) AS plain FROM part")
def f11_strip_descriptor(spark, sf_dir):
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), K.strip_descriptor(F.concat("p_name", F.lit("(I[Ljava/lang/String;)V"))).alias("stripped"), K.strip_descriptor(F.col("p_name")).alias("plain"))


@query("SELECT conv_id, turn, text AS decoded FROM conversations")
def f12_base64(spark, sf_dir):
    return A.table(spark, sf_dir, "conversations").select("conv_id", "turn", K.from_base64(F.base64(F.col("text").cast("binary"))).cast("string").alias("decoded"))


@query(f"WITH {_NODES} SELECT ticket, count(*) AS n FROM (SELECT DISTINCT ticket, name FROM nodes) GROUP BY ticket")
def a01_dedup_entries(spark, sf_dir):
    e = S.dedup(A.entries(spark, sf_dir).filter(K.is_named_edge(F.col("edge_kind"))))
    by_source = e.groupBy("source").agg(F.count("*").alias("n"))  # so that tickets are made once a node
    return by_source.groupBy(K.ticket(F.col("source")).alias("ticket")).agg(F.sum("n").alias("n"))


@query(f"WITH {_NAMES} SELECT name, ticket FROM names")
def a02_names(spark, sf_dir):
    return N.names_of(A.entries(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT ticket, label FROM labels")
def a03_labels(spark, sf_dir):
    return N.labels_of(N.names_of(A.entries(spark, sf_dir)))


@query(f"""WITH {_NODES}, x AS (SELECT lang AS label, CASE WHEN strlen(name) % 5 = 0 THEN 'failed' WHEN strlen(name) % 5 = 1 THEN 'empty' ELSE 'ok' END AS status, strlen(name) AS bytes FROM nodes)
  SELECT label, count(*) AS units, CAST(count_if(status = 'ok') AS BIGINT) AS ok, CAST(count_if(status = 'empty') AS BIGINT) AS empty, CAST(count_if(status = 'failed') AS BIGINT) AS failed, CAST(sum(bytes) AS BIGINT) AS bytes FROM x GROUP BY ROLLUP (label)""")
def a05_language_counts(spark, sf_dir):
    n = F.octet_length("name")
    status = F.when(n % 5 == 0, "failed").when(n % 5 == 1, "empty").otherwise("ok")
    counts = U.language_counts(A.nodes(spark, sf_dir).select(F.col("source.language").alias("label"), status.alias("status"), n.cast("long").alias("bytes")))
    return counts.select("label", "units", "ok", "empty", "failed", "bytes")


@query(f"WITH {_NAMES} SELECT name, ticket FROM names WHERE name = (SELECT min(p_name) FROM part)")
def j01_exact(spark, sf_dir):
    return N.exact(N.names_of(A.entries(spark, sf_dir)), first_name(spark, sf_dir))


@query(f"WITH {_NAMES} SELECT name, ticket FROM names WHERE contains(name, 'er') ORDER BY name, ticket LIMIT 50")
def j02_substr(spark, sf_dir):
    return N.containing(N.names_of(A.entries(spark, sf_dir)), "er", 50)


@query(f"WITH {_NAMES} SELECT r_name AS needle, name, ticket FROM names JOIN region ON contains(name, r_name)")
def j02_substr_bulk(spark, sf_dir):
    return graph(spark, sf_dir).names_with(A.table(spark, sf_dir, "region").select(F.col("r_name").alias("needle")))


_TURNS = """c AS (SELECT conv_id, turn, strlen(coalesce(text, '')) + 1 AS n FROM conversations),
  s AS (SELECT conv_id, turn, sum(n) OVER w - n AS ds, sum(n) OVER w AS de, lead(turn) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn))"""


@query(f"WITH {_TURNS} SELECT 'turn:' || conv_id || ':' || turn AS caller_ticket, 'turn:' || conv_id || ':' || nxt AS callee_ticket, CAST(ds AS BIGINT) AS ds, CAST(ds AS BIGINT) AS at FROM s WHERE nxt IS NOT NULL")
def j06_span_join(spark, sf_dir):
    return S.span_calls(*A.turns(spark, sf_dir))


@query("SELECT o_orderkey AS sha FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def j07_resume_anti(spark, sf_dir):
    done = A.table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("sha"))
    return A.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sha")).join(done, "sha", "left_anti")


@query(f"WITH {_NAMES} SELECT name, ticket, tickets FROM (SELECT name, ticket, count(*) OVER (PARTITION BY name) AS tickets FROM names) WHERE tickets > 1")
def j11_same_name(spark, sf_dir):
    return N.same_name(N.names_of(A.entries(spark, sf_dir)))


@query(f"""WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS language, coalesce(source, '') AS source, coalesce(CAST(n_chars AS VARCHAR), '') AS name FROM documents),
  m AS (SELECT DISTINCT 'kythe://' || {_enc("source")} || '?lang=jvm#' || {_enc("name")} AS name_ticket, 'kythe://' || {_enc("source")} || '?lang=' || {_enc("language")} || '?path=' || doc_id || '#doc' AS ticket, language FROM d WHERE name <> ''),
  k AS (SELECT name_ticket, count(*) AS tickets, count(DISTINCT language) AS languages FROM m GROUP BY name_ticket HAVING count(DISTINCT language) > 1)
  SELECT name_ticket, ticket, language, tickets, languages FROM m JOIN k USING (name_ticket)""")
def j11_bridge(spark, sf_dir):
    """Documents as symbols in their language and a corpus of their source; their length is the node that their name edge leads to."""
    return N.bridge(A.length_names(spark, sf_dir)).filter("language <> 'jvm'")


@query("SELECT p_partkey AS key, 'catalog/' || p_brand || '/' || p_type AS path FROM part WHERE contains(p_type, 'A') AND NOT contains(p_brand, '3')")
def p01_path_filter(spark, sf_dir):
    paths = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("key"), F.concat_ws("/", F.lit("catalog"), "p_brand", "p_type").alias("path"))
    return paths.filter(U.keeps(F.substring_index("path", "/", -1), "A")).filter(U.keeps(F.col("path"), "", "Brand#3")).filter(~F.contains(F.split_part("path", F.lit("/"), F.lit(2)), F.lit("3")))


@query("SELECT page_id, url, contains(url, '1') OR contains(url, '2') AS any_of, false AS only_empty FROM pages")
def p02_any_of(spark, sf_dir):
    return A.table(spark, sf_dir, "pages").select("page_id", "url", U.accepts(F.col("url"), ["1", "2"], []).alias("any_of"), U.accepts(F.col("url"), [""], []).alias("only_empty"))


@query(f"WITH {_NAMES}, {_ANCHORS} SELECT DISTINCT n.ticket FROM names n JOIN anchors a ON n.ticket = a.target_ticket WHERE name = (SELECT min(p_name) FROM part) AND kind = 'defines/binding' AND contains(path, 'URGENT')")
def p03_def_in(spark, sf_dir):
    return graph(spark, sf_dir).resolve(first_name(spark, sf_dir), def_in="URGENT")


@query(f"""WITH {_NODES} SELECT lang AS language, CASE WHEN lang = 'c++' THEN 'cxx' END AS label, count(*) AS n FROM nodes GROUP BY ALL""")
def p05_route(spark, sf_dir):
    n = A.nodes(spark, sf_dir).select(F.col("source.language").alias("language"))
    return n.withColumn("label", U.route(F.upper("language"))).groupBy("language", "label").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS sha, CASE WHEN o_orderstatus = 'F' THEN '-DNEW,-x' ELSE '-x' END AS argument FROM orders")
def p08_arguments(spark, sf_dir):
    a = F.array(F.lit("-fprofile-sample-use=p"), F.lit("-x"))
    o = A.table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("sha"), F.array_join(U.inject_arguments(U.strip_arguments(a), F.col("o_orderstatus"), U.parse_rules(["F::-DNEW", "F::-x"])), ",").alias("argument"))


@query(_items_sql("'definition'"))
def v01_def(spark, sf_dir):
    return graph(spark, sf_dir).definitions(first_name(spark, sf_dir))


@query(_items_sql("'reference', 'call'"))
def v02_ref(spark, sf_dir):
    return graph(spark, sf_dir).references(first_name(spark, sf_dir))


@query(_items_sql("'reference', 'call'", where="contains(path, 'URGENT') AND NOT contains(path, '7')", limit=3))
def v02_ref_filtered(spark, sf_dir):
    return graph(spark, sf_dir).references(first_name(spark, sf_dir), within="URGENT", without="7", limit=3)


@query(_items_sql("'caller', 'call'", parts="x.ticket, role", limit=10))
def v03_callers(spark, sf_dir):
    return graph(spark, sf_dir).callers(first_name(spark, sf_dir), limit=10)


@query(f"""WITH {_LABELS} SELECT {_CUSTOMER} AS ticket, '/kythe/edge/extends' AS kind, {_NATION} AS target_ticket, label, 'geo/' || r_name || '/' || n_name AS path
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN labels ON labels.ticket = {_NATION} WHERE c_name = (SELECT min(c_name) FROM customer)""")
def v04_super(spark, sf_dir):
    return graph(spark, sf_dir).supertypes(A.table(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0] or "")


@query(f"""WITH {_LABELS} SELECT {_NATION} AS ticket, '%/kythe/edge/extends/public' AS kind, {_SUPPLIER} AS target_ticket, label, 'geo/' || r_name || '/' || n_name || '/supplier' AS path
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN labels ON labels.ticket = {_SUPPLIER} WHERE n_name = (SELECT min(n_name) FROM nation)""")
def v05_sub(spark, sf_dir):
    return graph(spark, sf_dir).subtypes(A.table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0] or "", within="supplier", limit=1 << 20)


def _bfs_sql(edges: str, roots: str, depth: int, max_syms: int, direction: str, before: str = "") -> str:
    up = "SELECT callee_ticket AS at, caller_ticket AS nxt, 0 AS side, 0 AS k1, 0 AS k2 FROM e"
    down = "SELECT caller_ticket AS at, callee_ticket AS nxt, 1 AS side, ds AS k1, at_ AS k2 FROM e"
    steps = {"up": up, "down": down, "both": f"{up} UNION ALL {down}"}[direction]
    out = f"WITH {before}e AS ({edges}), steps AS ({steps}), f0 AS (SELECT row_number() OVER (ORDER BY ticket) - 1 AS id, -1 AS parent, 0 AS depth, ticket FROM ({roots}))"
    for d in range(1, depth + 1):
        out += f""", m{d} AS (SELECT f.id AS parent, s.nxt AS ticket, side, k1, k2 FROM f{d - 1} f JOIN steps s ON f.ticket = s.at WHERE f.depth = {d - 1} AND s.nxt NOT IN (SELECT ticket FROM f{d - 1})),
  n{d} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ticket ORDER BY parent, side, k1, k2) AS rn FROM m{d}) WHERE rn = 1),
  f{d} AS (SELECT * FROM f{d - 1} UNION ALL SELECT * FROM (SELECT (SELECT count(*) FROM f{d - 1}) + row_number() OVER (ORDER BY parent, side, k1, k2, ticket) - 1 AS id, parent, {d} AS depth, ticket FROM n{d}) WHERE id < {max_syms})"""
    return out + f" SELECT CAST(id AS BIGINT) AS id, CAST(parent AS BIGINT) AS parent, CAST(depth AS BIGINT) AS depth, ticket FROM f{depth}"


def _event(kind: str) -> str:
    return _tick("events", "'users/' || user_id", f"'u' || user_id || '::' || {kind}")


_EVENTS = f"""SELECT {_event("event_type")} AS caller_ticket, {_event("nxt")} AS callee_ticket, 0 AS ds, min(event_id) AS at_
  FROM (SELECT user_id, event_type, event_id, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nxt FROM events) WHERE nxt IS NOT NULL GROUP BY user_id, event_type, nxt"""
_ROOTS = "SELECT min(caller_ticket) AS ticket FROM e UNION SELECT max(caller_ticket) FROM e"


def _walk(calls: DataFrame, direction: str, depth: int, max_syms: int, stored: dict[str, DataFrame] | None = None) -> DataFrame:
    ends = calls.agg(F.array(F.min("caller_ticket"), F.max("caller_ticket")).alias("t")).select(F.explode("t").alias("ticket")).filter("ticket is not null")
    return callgraph(calls, ends, direction, depth, max_syms, stored=stored).select("id", "parent", "depth", "ticket")


@query(_bfs_sql(_EVENTS, _ROOTS, 3, 200, "up"))
def v06_callgraph_up(spark, sf_dir):
    calls, steps = event_steps(spark, sf_dir)
    return _walk(calls, "up", 3, 200, steps)


@query(_bfs_sql(_EVENTS, _ROOTS, 3, 200, "down"))
def v06_callgraph_down(spark, sf_dir):
    calls, steps = event_steps(spark, sf_dir)
    return _walk(calls, "down", 3, 200, steps)


@query(_bfs_sql("SELECT * FROM calls", _ROOTS, 2, 200, "both", before=f"{_ANCHORS}, "))
def v06_callgraph_both(spark, sf_dir):
    g = graph(spark, sf_dir)
    return _walk(g.t["call_edges"], "both", 2, 200, g.steps)


@query(f"WITH {_NAMES} SELECT name, ticket FROM names WHERE name = (SELECT min(s_name) FROM supplier)")
def v07_identifier(spark, sf_dir):
    return graph(spark, sf_dir).identifier(A.table(spark, sf_dir, "supplier").agg(F.min("s_name")).first()[0] or "")


@query(f"WITH {_NAMES} SELECT name, ticket FROM names WHERE contains(name, 'Customer#0000000') ORDER BY name, ticket LIMIT 50")
def v08_names(spark, sf_dir):
    return graph(spark, sf_dir).names("Customer#0000000")


@query(f"""WITH x AS (SELECT * FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c_name = (SELECT min(c_name) FROM customer))
  SELECT {_CUSTOMER} AS source_ticket, '/kythe/edge/extends' AS kind, CAST(NULL AS INTEGER) AS ordinal, {_NATION} AS target_ticket FROM x
  UNION ALL SELECT {_CUSTOMER}, '/kythe/edge/named', NULL, 'kythe://testdata?lang=jvm#' || {_enc("c_name")} FROM x""")
def v09_edges(spark, sf_dir):
    return graph(spark, sf_dir).edges(A.table(spark, sf_dir, "customer").agg(F.min("c_name")).first()[0] or "")


@query(f"WITH {_ANCHORS} SELECT target_ticket, kind, start_byte FROM anchors WHERE file_ticket = (SELECT min(file_ticket) FROM anchors)")
def v11_decor(spark, sf_dir):
    g = graph(spark, sf_dir)
    return g.decorations(g.t["anchors"].agg(F.min("file_ticket")).first()[0] or "")


@query("SELECT DISTINCT source || '/' || lang AS entry, false AS is_file FROM documents WHERE source = (SELECT min(source) FROM documents) AND text IS NOT NULL")
def v12_ls(spark, sf_dir):
    return graph(spark, sf_dir).ls(A.table(spark, sf_dir, "documents").agg(F.min("source")).first()[0] or "", corpus=A.CORPUS)


@query(f"""WITH s AS (SELECT {_SUPPLIER} AS a, {_NATION} AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT a AS source_ticket, '/kythe/edge/extends/public' AS kind, b AS target_ticket, false AS reverse FROM s UNION ALL SELECT b, '%/kythe/edge/extends/public', a, true FROM s""")
def b01_edges(spark, sf_dir):
    kind = "/kythe/edge/extends/public"
    return S.edges(A.entries(spark, sf_dir)).filter(F.col("kind").isin(kind, f"%{kind}")).select("source_ticket", "kind", "target_ticket", "reverse")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL)
  SELECT doc_id, CAST(n AS BIGINT) AS line_number, CAST(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(t) - 1 AS BIGINT) AS line_start, CAST(sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS line_end FROM l""")
def b04_lines(spark, sf_dir):
    files = A.document_files(spark, sf_dir)
    return S.lines(files.select(F.col("doc_id").alias("file_ticket"), "text")).select(F.col("file_ticket").alias("doc_id"), "line_number", "line_start", "line_end")


@query("""WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS t FROM documents WHERE text IS NOT NULL),
  p AS (SELECT doc_id, n, sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY n) - strlen(t) - 1 AS a, sum(strlen(t) + 1) OVER (PARTITION BY doc_id ORDER BY n) AS b FROM l),
  x AS (SELECT doc_id, strlen(text) * k // 4 AS at_ FROM documents, range(4) r(k) WHERE text IS NOT NULL)
  SELECT x.doc_id, CAST(at_ AS BIGINT) AS start_byte, CAST(n AS BIGINT) AS line, CAST(at_ - a AS BIGINT) AS col FROM x JOIN p ON x.doc_id = p.doc_id AND at_ >= a AND at_ < b""")
def b04_place(spark, sf_dir):
    files = A.document_files(spark, sf_dir)
    at = F.explode(F.sequence(F.lit(0), F.lit(3)))
    marks = files.select("file_ticket", "doc_id", F.octet_length("text").cast("long").alias("n"), at.alias("k")).select("file_ticket", "doc_id", F.expr("n * k div 4").alias("start_byte"))
    return S.place(marks, files.select("file_ticket", "text")).select("doc_id", "start_byte", "line", "col")


_CHAT = f"""t AS (SELECT conv_id, turn, text, len, sum(len) OVER w - len AS ds, sum(len) OVER w AS de, lead(turn) OVER w AS nxt, lines - 1 - strlen(text) + strlen(replace(text, chr(10), '')) AS line, {{path}} AS path FROM (
    SELECT conv_id, turn, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS len, sum(strlen(coalesce(text, '')) - strlen(replace(coalesce(text, ''), chr(10), '')) + 1) OVER (PARTITION BY conv_id ORDER BY turn) + 1 AS lines FROM conversations)
    WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  c AS (SELECT *, {_tick("", "{path}", "")} AS file, {_tick("turn", "{path}", "'t' || turn")} AS symbol, {_tick("turn", "{path}", "'t' || nxt")} AS next_symbol,
    {_tick("turn", "{path}", "'@' || ds || ':' || de")} AS place, {_tick("turn", "{path}", "'call@' || ds")} AS call FROM t),
  a AS (SELECT place AS anchor_ticket, file AS file_ticket, path, ds AS start_byte, de AS end_byte, 'defines/binding' AS kind, symbol AS target_ticket, line, text FROM c
    UNION ALL SELECT call, file, path, ds, ds + 1, 'ref/call', next_symbol, line, text FROM c WHERE nxt IS NOT NULL)""".replace("{path}", "'chat/' || conv_id || '.txt'")
_HEX = "'1A' || printf('%02X', strlen({0}) + 2) || '12' || printf('%02X', strlen({0})) || hex({0})"
_CODE = f"{_HEX.format("('c' || conv_id)")} || {_HEX.format("('t' || turn)")} || '22023A3A'"


@query(f"""WITH {_CHAT}, f AS (
    SELECT file AS ticket, '/kythe/node/kind' AS fact_name, hex('file') AS value FROM (SELECT DISTINCT file FROM c)
    UNION ALL SELECT file, '/kythe/text', hex(string_agg(text, chr(10) ORDER BY turn)) FROM c GROUP BY file
    UNION ALL SELECT anchor_ticket, '/kythe/node/kind', hex('anchor') FROM a UNION ALL SELECT anchor_ticket, '/kythe/loc/start', hex(CAST(start_byte AS VARCHAR)) FROM a
    UNION ALL SELECT anchor_ticket, '/kythe/loc/end', hex(CAST(end_byte AS VARCHAR)) FROM a UNION ALL SELECT symbol, '/kythe/code', {_CODE} FROM c)
  SELECT ticket, fact_name, value FROM f""")
def b02_facts(spark, sf_dir):
    return S.facts(chat(spark, sf_dir)).select("ticket", "fact_name", F.hex("fact_value").alias("value"))


@query(f"""WITH {_CHAT} SELECT anchor_ticket, file_ticket, path, CAST(start_byte AS BIGINT) AS start_byte, CAST(end_byte AS BIGINT) AS end_byte, kind, target_ticket, CAST(line AS BIGINT) AS line, CAST(0 AS BIGINT) AS col,
    regexp_replace(split_part(text, chr(10), 1), '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS snippet FROM a""")
def b03_anchors(spark, sf_dir):
    return S.anchors(chat(spark, sf_dir))


@query(f"""WITH {_CHAT}, x AS (
    SELECT target_ticket, CASE kind WHEN 'ref/call' THEN 'call' ELSE 'definition' END AS role, anchor_ticket AS item_ticket, path, start_byte, line FROM a
    UNION ALL SELECT next_symbol, 'caller', symbol, path, ds, line FROM c WHERE nxt IS NOT NULL)
  SELECT target_ticket, role, item_ticket, path, CAST(start_byte AS BIGINT) AS start_byte, CAST(line AS BIGINT) AS line FROM x""")
def b05_xrefs(spark, sf_dir):
    a = S.anchors(chat(spark, sf_dir))
    return S.xrefs(a, S.call_edges(a)).select("target_ticket", "role", "item_ticket", "path", "start_byte", "line")


@query(f"WITH {_CHAT} SELECT symbol AS caller_ticket, next_symbol AS callee_ticket, CAST(ds AS BIGINT) AS ds, CAST(ds AS BIGINT) AS at, true AS direct FROM c WHERE nxt IS NOT NULL")
def b06_call_edges(spark, sf_dir):
    return S.call_edges(S.anchors(chat(spark, sf_dir)))


_NESTED = """c AS (SELECT conv_id AS file, turn, lead(turn) OVER w AS nxt, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, sum(strlen(coalesce(text, '')) + 1) OVER w AS de, strlen(coalesce(text, '')) + 1 AS len
    FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
  d AS (SELECT a.file, a.turn, a.de - a.len AS ds, b.de FROM c a JOIN c b ON a.file = b.file AND b.i = least(a.n, a.i + (a.i & -a.i) - 1) WHERE a.i % 2 = 0),
  m AS (SELECT 'turn:' || d.file || ':' || d.turn AS caller_ticket, 'turn:' || c.file || ':' || nxt AS callee_ticket, d.ds, c.de - c.len AS at_,
      row_number() OVER (PARTITION BY c.file, c.i ORDER BY d.ds DESC, d.de, d.turn) = 1 AS direct FROM c JOIN d ON c.file = d.file AND c.de - c.len >= d.ds AND c.de - c.len < d.de WHERE nxt IS NOT NULL)"""


@query(f"WITH {_NESTED} SELECT caller_ticket, callee_ticket, CAST(min(ds) AS BIGINT) AS ds, CAST(min(at_) AS BIGINT) AS at, bool_or(direct) AS direct FROM m GROUP BY caller_ticket, callee_ticket")
def b06_nested_calls(spark, sf_dir):
    """Definitions inside definitions: each call has all that hold it as callers down, and one direct caller."""
    return S.call_edges(A.nested_turns(spark, sf_dir))


@query(f"WITH {_CHAT} SELECT file AS file_ticket, 'testdata' AS corpus, path, string_agg(text, chr(10) ORDER BY turn) AS text FROM c GROUP BY file, path")
def b07_files(spark, sf_dir):
    return S.files(chat(spark, sf_dir))


@query(f"WITH {_CHAT} SELECT 'c' || conv_id || '::t' || turn AS name, symbol AS ticket FROM c")
def u02_code_names(spark, sf_dir):
    return N.names_of(chat(spark, sf_dir))


@query(f"WITH {_CHAT} SELECT symbol AS ticket, '/kythe/code' AS fact_name, {_CODE} AS value FROM c WHERE 'c' || conv_id || '::t' || turn = (SELECT min('c' || conv_id || '::t' || turn) FROM c)")
def v10_nodes(spark, sf_dir):
    g = CodeGraph.from_entries(chat(spark, sf_dir))
    return g.nodes(g.t["names"].agg(F.min("name")).first()[0] or "").select("ticket", "fact_name", F.hex("fact_value").alias("value"))


@query(f"""WITH {_CHAT}, n AS (SELECT count(*) AS t, count(nxt) AS k, count(DISTINCT conv_id) AS f FROM c)
  SELECT 'names' AS "table", t AS "rows" FROM n UNION ALL SELECT 'labels', t FROM n UNION ALL SELECT 'xrefs', t + 2 * k FROM n UNION ALL SELECT 'edges', 2 * (t + k) FROM n
  UNION ALL SELECT 'facts', 2 * f + 3 * (t + k) + t FROM n UNION ALL SELECT 'anchors', t + k FROM n UNION ALL SELECT 'files', f FROM n UNION ALL SELECT 'call_edges', k FROM n""")
def v17_build(spark, sf_dir):
    folder = f"{shared_folder(spark)}/serving-{uuid.uuid4().hex}"
    S.build(chat(spark, sf_dir), folder)
    return CodeGraph.load(spark, folder).stat().select("table", "rows")


@query("SELECT DISTINCT user_id, event_type FROM events")
def t03_stream_fold(spark, sf_dir):
    """Events stream in, distinct pairs are folded into a store that the session's shared folder holds."""
    out = f"{shared_folder(spark)}/fold-{uuid.uuid4().hex}"
    schema = A.table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("maxFilesPerTrigger", 48).parquet(f"{sf_dir}/events*.parquet")
    fold(tagged(stream, {"pairs": F.array(F.struct("user_id", "event_type"))}), out)
    return read_store(spark, out, "pairs")


