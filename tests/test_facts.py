"""What lines say, once each: by keys, also where keys are null."""

import datetime
import shutil
from pathlib import Path

from weftgraph.plans import adapters

FIELDS = "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_returnflag string, l_linestatus string, l_shipdate date"


def test_line_facts_are_distinct_by_keys(spark, sf_dir, tmp_path):
    day = datetime.date(1995, 3, 1)
    rows = [(1, 1, 2, 3, "R", "F", day), (1, 1, 2, 3, "R", "F", day), (1, 2, 2, 3, "R", "F", day), (1, 1, 2, 3, "A|B", "C", day), (1, 1, 2, 3, "A", "B|C", day)]
    rows += [(5, 1, None, 3, "R", None, None), (5, 1, 3, None, None, "R", day), (None, 5, 1, 3, "R", "F", day), (5, None, 1, 3, "R", "F", day), (None,) * 6 + (day,), (None,) * 6 + (day,)]
    for x in Path(sf_dir).glob("*.parquet"):
        if x.name != "lineitem.parquet":
            (shutil.copytree if x.is_dir() else shutil.copy)(x, tmp_path / x.name)
    spark.createDataFrame(rows, FIELDS).write.parquet(str(tmp_path / "lineitem.parquet"))
    text = lambda *c: ".".join(str(x) for x in c if x is not None)
    term = lambda p, x: None if x is None else f"{p}:{x}"
    want = {
        "ctd:gene": {(text("IXN:", o, n, p, s), term("GENE", s)) for o, n, p, s, *_ in rows},
        "ctd:types": {(text("IXN:", o, n, p, s), "|".join(x for x in (a, b) if x is not None)) for o, n, p, s, a, b, _ in rows},
        "drugbank:target": {(term("DRUG", p), term("GENE", s)) for _, _, p, s, *_ in rows},
    }
    for p, pairs in want.items():
        facts = adapters.chem_quads(spark, str(tmp_path)).where(f"p = '{p}'").select("s", "o")
        assert "keys=[l_" in facts._jdf.queryExecution().executedPlan().toString()
        assert sorted((tuple(r) for r in facts.collect()), key=repr) == sorted(pairs, key=repr)


def test_records_are_the_join_of_facts(spark, sf_dir, tmp_path):
    """Lines and orders that are repeated, contradict each other or have nulls: a graph's records give what its quads give, with their multiplicity."""
    from collections import Counter

    from weftgraph.operators.bgp import bgp
    from weftgraph.plans import domain

    day = lambda y: datetime.date(y, 3, 1)
    rows = [(1, 1, 2, 3, "R", "F", day(1995)), (1, 1, 2, 3, "R", "F", day(1995)), (1, 1, 2, 3, "A", "O", day(1996)), (1, 2, 2, 4, "R", "F", day(1995)), (2, 1, 2, 3, "N", "O", day(1997)), (2, 2, 5, 3, "N", None, day(1997))]
    rows += [(5, 1, None, 3, "R", "F", day(1995)), (5, 1, 3, None, "A", "F", day(1996)), (None, 5, 1, 3, "R", "F", day(1995)), (5, None, 1, 3, "R", "F", None), (None,) * 6 + (day(1995),)]
    for x in Path(sf_dir).glob("*.parquet"):
        if x.name not in ("lineitem.parquet", "orders.parquet"):
            (shutil.copytree if x.is_dir() else shutil.copy)(x, tmp_path / x.name)
    spark.createDataFrame(rows, FIELDS).write.parquet(str(tmp_path / "lineitem.parquet"))
    orders = [(1, 7, "F", "1"), (1, 8, "O", "2"), (2, 7, "F", "1"), (5, None, "F", "1"), (None, 7, "F", "1"), (9, 7, None, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    graph, quads = adapters.chem_graph(spark, str(tmp_path)), adapters.chem_quads(spark, str(tmp_path))
    evidence = [("?ixn", p, f"?{p[-4:]}") for p in ("ctd:types", "ctd:pubmedids", "ctd:interaction", "ctd:chemicalid")]
    asked = [domain.IXN, domain.IXN + evidence[:1], domain.IXN + evidence, evidence, domain.DISEASE, [*domain.DISEASE, ("?assoc", "ctd:pmids", "?pmids")], domain.DISEASE + domain.IXN]
    for patterns in asked:
        select = sorted({t[1:] for pattern in patterns for t in pattern if t.startswith("?")})
        for distinct in (False, True):
            for some in (select, [c for c in select if c not in ("ixn", "assoc")]):
                got, want = (Counter(map(tuple, bgp(g, patterns, some, distinct=distinct).collect())) for g in (graph, quads))
                assert got == want and got
    ids = spark.createDataFrame([("GENE:3",), ("GENE:9",)], "id string")
    got, want = (set(map(tuple, bgp(g, domain.IXN, ["compound", "gene"], {"gene": ids}, distinct=True).collect())) for g in (graph, quads))
    assert got == want and {g for _, g in got} == {"GENE:3"}


def test_lines_are_not_joined_with_themselves(spark, sf_dir):
    """Drugs to genes shuffle each line's pair twice at most, not its facts one by one."""
    from tests.test_hubs import shuffled_rows
    from weftgraph import registry

    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    n, _ = shuffled_rows(spark, lambda: registry.QUERIES["q_drug_to_gene"](spark, sf_dir).collect())
    assert n < 4 * lines


def test_the_greatest_tables_are_joined_last():
    """Drugs have one compound: they are joined before genes and diseases meet over it, so that the hub is no column of what is joined there."""
    from weftgraph.operators.bgp import join_tree

    sets = [{"drug", "compound"}, {"drug", "drug_name"}, {"compound", "gene"}, {"compound", "disease"}]
    assert join_tree(sets, {"drug_name", "gene", "disease"}, [20, 20, 7000, 7000])[:2] == [(0, 1), (1, 2)] or join_tree(sets, {"drug_name", "gene", "disease"}, [20, 20, 7000, 7000])[:2] == [(1, 0), (0, 2)]


def test_evidence_over_a_hub(spark, monkeypatch):
    """Publications of all ways, as bits and as texts; those without any do not count."""
    from weftgraph.plans import domain

    quads = [("d1", "label", "Name one"), ("d2", "label", "name two"), ("d3", "label", "other")]
    for i in range(40):
        quads += [(f"a{i}", "ctd:disease", f"d{i % 3 + 1}"), (f"a{i}", "ctd:cid", f"c{i % 5}"), (f"a{i}", "ctd:pmids", ["x|y", "", "z | x", "|"][i % 4])]
        quads += [(f"i{i}", "ctd:cid", f"c{i % 7}"), (f"i{i}", "ctd:gene", f"g{i % 6}"), (f"i{i}", "ctd:pubmedids", ["", "p", "q|p"][i % 3])]
    of = {p: [(s, o) for s, q, o in quads if q == p] for p in {p for _, p, _ in quads}}
    want = {}
    for a, d in of["ctd:disease"]:
        for i, g in of["ctd:gene"]:
            if d != "d3" and dict(of["ctd:cid"])[a] == dict(of["ctd:cid"])[i]:
                said = f"{dict(of['ctd:pmids'])[a]}|{dict(of['ctd:pubmedids'])[i]}".split("|")
                want.setdefault((d, g), set()).update(x.strip() for x in said if x.strip())
    df = spark.createDataFrame([("g", *q) for q in quads], "g string, s string, p string, o string")
    names = spark.createDataFrame([("name",)], "name string")
    for most in (30, 2):
        monkeypatch.setattr(domain, "SET", most)
        got = [tuple(r) for r in domain.disease_name_to_gene(df, names).collect()]
        assert sorted(got) == sorted(("name", d, g, "|".join(sorted(x))) for (d, g), x in want.items() if x)
