"""The fourteen competency questions, as parameterised SQL over the review graph."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..bindings import TABLES, VIEWS, view
from ..operators.closure import reachable
from ..operators.lineage import saver
from ..operators.store import project_edges
from ..registry import register

#: Named parameters of the questions and their defaults.
DEFAULTS = {"review": "ASIA", "problem": 7, "least": 3, "work": 33, "close": 0.75}

QUESTIONS = {
    "CQ01": """SELECT DISTINCT r.cluster_id, x.role, r.work_id FROM reviews r JOIN (
        SELECT citing AS work_id, 'hub' AS role FROM citations GROUP BY citing HAVING count(*) >= 5 UNION ALL
        SELECT cited, 'foundational' FROM citations GROUP BY cited HAVING count(*) >= 5) x ON x.work_id = r.work_id WHERE r.review_id = :review AND r.decision = 'include'""",
    "CQ03": """SELECT DISTINCT c.method, c.work_id, CAST(o.dataset AS STRING) AS dataset, o.metric FROM contributions c LEFT JOIN
        (SELECT work_id, method, dataset, metric FROM contributions WHERE metric = 'R') o ON o.work_id = c.work_id AND o.method = c.method WHERE c.problem = :problem""",
    "CQ04": """SELECT dataset, metric, method, work_id, value FROM (SELECT c.dataset, c.metric, c.method, c.work_id, c.value,
        rank() OVER (PARTITION BY c.dataset, c.metric ORDER BY CASE WHEN c.metric = 'N' THEN c.value ELSE -c.value END) AS place
        FROM contributions c JOIN reviews r ON r.work_id = c.work_id WHERE r.review_id = :review AND r.decision = 'include') t WHERE place = 1""",
    "CQ05": """SELECT p.problem, m.method FROM (SELECT problem FROM contributions c JOIN reviews r ON r.work_id = c.work_id WHERE r.review_id = :review AND metric = 'R' GROUP BY problem HAVING count(DISTINCT c.work_id) >= :least) p
        CROSS JOIN (SELECT method FROM contributions c JOIN reviews r ON r.work_id = c.work_id WHERE r.review_id = :review AND metric = 'R' GROUP BY method HAVING count(DISTINCT c.work_id) >= :least) m
        WHERE NOT EXISTS (SELECT 1 FROM contributions c JOIN reviews r ON r.work_id = c.work_id WHERE r.review_id = :review AND metric = 'R' AND c.problem = p.problem AND c.method = m.method)""",
    "CQ06": """SELECT e.topic, count(DISTINCT e.work_id) AS works, max(e.issued) AS latest FROM topics e WHERE e.kind = 'error' GROUP BY e.topic
        HAVING count(DISTINCT e.work_id) >= :least AND NOT EXISTS (SELECT 1 FROM topics p WHERE p.kind = 'purchase' AND p.topic = e.topic AND p.issued > max(e.issued))""",
    "CQ07": """SELECT DISTINCT c.claim, c.other FROM claims c JOIN reviews a ON a.work_id = c.claim JOIN reviews b ON b.work_id = c.other
        WHERE c.stance <> c.other_stance AND a.review_id = :review AND b.review_id = :review AND a.decision = 'include' AND b.decision = 'include'""",
    "CQ08": """SELECT a.method AS a, b.method AS b FROM (SELECT DISTINCT method FROM contributions) a JOIN (SELECT DISTINCT method FROM contributions) b ON a.method < b.method
        WHERE NOT EXISTS (SELECT 1 FROM (SELECT work_id, method, dataset FROM contributions WHERE metric = 'R') x JOIN (SELECT work_id, method, dataset FROM contributions WHERE metric = 'R') y
            ON x.dataset = y.dataset AND x.work_id = y.work_id WHERE x.method = a.method AND y.method = b.method)""",
    "CQ09": """SELECT c.cluster_id, round(avg(CASE WHEN w.year >= 2000 THEN 1e0 ELSE 0e0 END), 6) AS growth, min(w.id) AS first_seen FROM clusters c JOIN works w ON w.id = c.work_id GROUP BY c.cluster_id""",
    "CQ10": """SELECT s.share, v.venue FROM (SELECT round(avg(CASE WHEN work_type = 'O' THEN 1e0 ELSE 0e0 END), 6) AS share FROM works WHERE year >= 2000) s
        LEFT JOIN (SELECT DISTINCT venue FROM works WHERE year >= 2000 AND work_type = 'O') v ON true""",
    "CQ11": """SELECT x.cluster_id AS a, y.cluster_id AS b FROM (SELECT cluster_id, avg(cited_by_count) AS m FROM eras JOIN works ON id = work_id GROUP BY cluster_id) x
        JOIN (SELECT cluster_id, avg(cited_by_count) AS m FROM eras JOIN works ON id = work_id GROUP BY cluster_id) y ON x.cluster_id < y.cluster_id
        LEFT JOIN (SELECT DISTINCT least(u.cluster_id, v.cluster_id) AS a, greatest(u.cluster_id, v.cluster_id) AS b FROM citations JOIN eras u ON u.work_id = citing JOIN eras v ON v.work_id = cited) c ON c.a = x.cluster_id AND c.b = y.cluster_id
        WHERE c.a IS NULL AND least(x.m, y.m) / greatest(x.m, y.m) >= :close""",
    "CQ12": """SELECT DISTINCT c.method, c.value, w.title, w.year, r.stage FROM contributions c JOIN works w ON w.id = c.work_id JOIN reviews r ON r.work_id = c.work_id WHERE c.work_id = :work""",
    "CQ13": """SELECT r.work_id, r.reason, r.stage FROM reviews r WHERE r.review_id = :review AND r.decision = 'exclude'""",
    "CQ14": """SELECT p.p_partkey AS gap, p.p_brand AS note, l.n FROM part p LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) l ON l.l_partkey = p.p_partkey WHERE p.p_size > 40""",
}


def literal(value: object) -> str:
    return "'" + str(value).replace("'", "''") + "'" if isinstance(value, str) else str(value)


def answer(spark: SparkSession, text: str, tables: Callable[[str], DataFrame], **given: object) -> DataFrame:
    """A question over the tables that it names; parameters are bound by name, never spliced into the text."""
    args = {k: v for k, v in (DEFAULTS | given).items() if re.search(rf":{k}\b", text)}
    used = [t for t in (*VIEWS, *TABLES) if re.search(rf"\b(FROM|JOIN) {t}\b", text)]
    marked = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", text)
    return spark.sql(marked, args=args, **{t: tables(t) for t in used}) if args else spark.sql(marked, **{t: tables(t) for t in used})


def _add(name: str, text: str) -> None:
    bound = re.sub(r":([a-z]+)\b", lambda m: literal(DEFAULTS[m[1]]) if m[1] in DEFAULTS else m[0], text)

    @register(name, bound)
    def ask(spark: SparkSession, sf: str) -> DataFrame:
        return answer(spark, text, lambda t: view(spark, sf, t))


for _name, _text in QUESTIONS.items():
    _add(_name, _text)


OWN = f"SELECT citing, cited FROM citations WHERE citing IN (SELECT work_id FROM inclusions WHERE project_id = '{DEFAULTS["review"]}') AND cited IN (SELECT work_id FROM inclusions WHERE project_id = '{DEFAULTS["review"]}')"


@register("CQ02", f"""WITH RECURSIVE own AS ({OWN}), seed AS (SELECT min(citing) AS id FROM own), down AS (SELECT cited AS id FROM own WHERE citing = (SELECT id FROM seed) UNION SELECT cited FROM own JOIN down ON citing = down.id),
    up AS (SELECT citing AS id FROM own WHERE cited = (SELECT id FROM seed) UNION SELECT citing FROM own JOIN up ON cited = up.id),
    reach AS (SELECT id FROM down UNION SELECT id FROM up UNION SELECT id FROM seed)
    SELECT citing, cited FROM own WHERE citing IN (SELECT id FROM reach) AND cited IN (SELECT id FROM reach)""")
def cq02(spark: SparkSession, sf: str) -> DataFrame:
    """Citations of a review among a seed, what it leads to and what leads to it."""
    own = saver(spark)(project_edges(*(view(spark, sf, v) for v in ("citations", "inclusions")), DEFAULTS["review"]))
    seed = own.agg(F.min("citing").alias("id"))
    start = seed.first()["id"]
    reach = reachable(own, start).union(reachable(own, start, "cited", "citing")).union(seed).distinct()
    ends = lambda c: reach.select(F.col("id").alias(c))
    return own.join(ends("citing"), "citing", "left_semi").join(ends("cited"), "cited", "left_semi").select("citing", "cited")
