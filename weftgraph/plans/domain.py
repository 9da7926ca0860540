"""The named questions, as graph patterns over quads and joins over association tables.

Predicates are data: each function names those it reads, and tables in other words are renamed to
them first (see plans.adapters for the given tables).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.codes import Coding, codings
from weftgraph.functions.curie import curie_prefix, path_last, rewrite_prefix, split_multi, un_curie
from weftgraph.operators.bgp import Graph
from weftgraph.operators.filters import limit_each, pick, pmids
from weftgraph.operators.joins import listed_join
from weftgraph.operators.ontology import closure, having_ancestor, property_path
from weftgraph.operators.patterns import bgp, containing, lookup_fallback, neighbors
from weftgraph.operators.patterntable import matching_table
from weftgraph.operators.typegraph import execute_programs, program_of, transitions_of
from weftgraph.storage import scratch, written

#: Different publications, at most, whose sets are kept as the bits of a number.
SET = 30
#: Patterns of chemical, gene, pathway and disease records, put together by the questions below.
IXN = [("?ixn", "ctd:cid", "?compound"), ("?ixn", "ctd:gene", "?gene")]
PATHWAY = [("?gene", "pharmgkb:uniprot", "?uniprot"), ("?uniprot", "kegg:path", "?path"), ("?path", "kegg:name", "?path_name")]
DRUG = [("?drug", "drugbank:cid", "?compound"), ("?drug", "drugbank:name", "?drug_name")]
DISEASE = [("?assoc", "ctd:disease", "?disease"), ("?assoc", "ctd:cid", "?compound")]


def exposure_conditions(quads: DataFrame, chemicals: DataFrame) -> DataFrame:
    """Chemicals to genes to pathways, with whether the pathway is a human one."""
    out = bgp(quads, IXN + PATHWAY, ["compound", "gene", "path", "path_name"], {"compound": chemicals})
    return out.withColumns({"path_id": path_last(F.col("path")), "human": F.contains("path_name", F.lit("(human)"))})


def drugs_by_condition(quads: DataFrame, conditions: DataFrame) -> DataFrame:
    """Conditions to the drugs of their compounds, with the publications of the association."""
    return bgp(quads, DISEASE + [("?assoc", "ctd:pmids", "?pmids"), *DRUG], ["disease", "compound", "pmids", "drug", "drug_name"], {"disease": conditions})


def drugs_by_condition_graph(quads: DataFrame, conditions: DataFrame) -> DataFrame:
    """drugs_by_condition as edges to the drug's last path segment."""
    return drugs_by_condition(quads, conditions).select(F.col("disease").alias("source_id"), path_last(F.col("drug")).alias("target_id"), "compound", "pmids")


def drugs_by_disease(quads: DataFrame, conditions: DataFrame) -> DataFrame:
    """Distinct conditions, drug names and drugs."""
    return bgp(quads, DISEASE + DRUG, ["disease", "drug_name", "drug"], {"disease": conditions}, distinct=True)


def genes_pathways_by_disease(quads: DataFrame, diseases: DataFrame, limit: int | None = None) -> DataFrame:
    """Diseases to drugs, their target genes and the genes' pathways; limit: rows of each disease."""
    out = bgp(quads, DISEASE + DRUG + [("?drug", "drugbank:target", "?gene")] + PATHWAY, ["disease", "drug", "gene", "path", "path_name"], {"disease": diseases}, distinct=True)
    return limit_each(out, "disease", limit) if limit else out


def genes_by_disease_graph(quads: DataFrame, diseases: DataFrame, limit: int | None = None) -> DataFrame:
    """genes_pathways_by_disease as edges to UNIPROT genes; limit: edges of each disease."""
    rows = bgp(quads, DISEASE + DRUG[:1] + [("?drug", "drugbank:target", "?gene")] + PATHWAY[:2], ["disease", "gene", "path"], {"disease": diseases}, distinct=True)
    out = rows.select(F.col("disease").alias("source_id"), F.concat(F.lit("UNIPROT:"), un_curie(F.col("gene"))).alias("target_id"), F.col("path").alias("kegg_path"))
    return limit_each(out, "source_id", limit) if limit else out


def named(quads: DataFrame, predicate: str, names: DataFrame, patterns: bool = False) -> DataFrame:
    """(name, id, label): the subjects of a predicate whose object contains one of the names (name), in any case; patterns: names are regular expressions."""
    labels = quads.where(F.col("p") == predicate).select(F.col("s").alias("id"), F.col("o").alias("label"))
    return matching_table(labels, names.withColumnRenamed("name", "pattern")).withColumnRenamed("pattern", "name") if patterns else containing(labels, names)


def drug_gene_disease(quads: DataFrame, drugs: DataFrame, diseases: DataFrame, patterns: bool = False) -> DataFrame:
    """Genes and diseases of compounds whose drug and disease names contain one of the names (name) of each kind."""
    asked = named(quads, "drugbank:name", drugs, patterns).select("id"), named(quads, "label", diseases, patterns).select("id")
    return bgp(quads, DRUG + IXN + DISEASE + [("?disease", "label", "?disease_name")], ["drug_name", "gene", "disease", "disease_name"], {"drug": asked[0], "disease": asked[1]}, distinct=True)


def compound_genes(quads: DataFrame, compounds: DataFrame) -> DataFrame:
    """Compounds to genes with the interaction, the chemical's MeSH id, and types and publications as arrays."""
    evidence = [("?ixn", "ctd:chemicalid", "?mesh"), ("?ixn", "ctd:interaction", "?interaction"), ("?ixn", "ctd:types", "?types"), ("?ixn", "ctd:pubmedids", "?pmids")]
    out = bgp(quads, IXN + evidence, ["compound", "gene", "mesh", "interaction", "types", "pmids"], {"compound": compounds}, distinct=True)
    return out.withColumns({c: split_multi(F.col(c)) for c in ("types", "pmids")})


def drug_name_to_gene(quads: DataFrame, names: DataFrame, patterns: bool = False) -> DataFrame:
    """(name, drug, drug_name, gene, pmids): the names' drugs, to genes, with the publications of the interaction."""
    found = named(quads, "drugbank:name", names, patterns).withColumnsRenamed({"id": "drug", "label": "drug_name"})
    genes = bgp(quads, [*DRUG[:1], *IXN, ("?ixn", "ctd:pubmedids", "?pmids")], ["drug", "gene", "pmids"], {"drug": found.select("drug")}, distinct=True)
    return found.join(genes, "drug").select("name", "drug", "drug_name", "gene", "pmids").distinct()


def drug_name_to_compound(quads: DataFrame, names: DataFrame, patterns: bool = False) -> DataFrame:
    """(name, compound, drug_name): the names' drugs, to compounds."""
    found = named(quads, "drugbank:name", names, patterns).withColumnsRenamed({"id": "drug", "label": "drug_name"})
    return found.join(bgp(quads, DRUG[:1], ["drug", "compound"]), "drug").select("name", "compound", "drug_name").distinct()


def drug_name_to_id(quads: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """(name, drug_name, target_id): the names' drugs, as identifiers of another vocabulary."""
    return named(quads, "drugbank:name", names).select("name", F.col("label").alias("drug_name"), F.concat(F.lit(f"{prefix}:"), un_curie(F.col("id"))).alias("target_id")).distinct()


def drug_name_to_provider_id(ligands: DataFrame, names: DataFrame) -> DataFrame:
    """(name, id, label): a provider's ligands (id, name) whose name contains one of the names."""
    return containing(ligands.select("id", F.col("name").alias("label")), names).distinct()


def pathways_by_gene(quads: DataFrame, genes: DataFrame, limit: int | None = None) -> DataFrame:
    """Genes to pathways over the protein that both name; limit: rows of each gene.

    A gene counts if a drug target's record of it has a GeneBank id; and only if any compound has a pathway interaction, a drug with a name and a disease.
    """
    tests = [("?target", "drugbank:GeneBank_ID", "?bank"), ("?inter", "kegg:cid", "?compound"), *DRUG, *DISEASE]
    target = [("?target", "drugbank:gene", "?gene"), ("?target", "drugbank:SwissProt_ID", "?protein")]
    out = bgp(quads, [("?path", "kegg:protein", "?protein"), PATHWAY[2], *target, *tests], ["gene", "path", "path_name"], {"gene": genes}, distinct=True)
    return limit_each(out, "gene", limit) if limit else out


def pathways_by_symbol(quads: DataFrame, symbols: DataFrame, limit: int | None = None) -> DataFrame:
    """(gene, protein, path, path_name): gene symbols that a chemical interaction names, over their records to pathways; limit: rows of each gene."""
    record = [("?record", "pharmgkb:Symbol", "?gene"), ("?record", "pharmgkb:UniProt_Id", "?protein")]
    out = bgp(quads, [("?path", "kegg:protein", "?protein"), PATHWAY[2], *record, ("?ixn", "ctd:gene", "?gene")], ["gene", "protein", "path", "path_name"], {"gene": symbols}, distinct=True)
    return limit_each(out, "gene", limit) if limit else out


def same_as(quads: DataFrame, predicate: str, prefix: str) -> DataFrame:
    """Subjects of a predicate to objects of a vocabulary, by the object's last colon-separated part."""
    rows = quads.where((F.col("p") == predicate) & F.startswith("o", F.lit(f"{prefix}:")))
    return rows.select(F.col("s").alias("source_id"), F.concat(F.lit(f"{prefix}:"), F.substring_index("o", ":", -1)).alias("target_id")).distinct()


def drug_to_gene(quads: DataFrame, drugs: DataFrame) -> DataFrame:
    """Drugs to the genes of their compounds (the connected form)."""
    return bgp(quads, DRUG[:1] + IXN, ["drug", "gene"], {"drug": drugs}, distinct=True)


def disease_to_gene(quads: DataFrame, diseases: DataFrame) -> DataFrame:
    """Diseases to the genes of their compounds (the connected form)."""
    return bgp(quads, DISEASE + IXN, ["disease", "gene"], {"disease": diseases}, distinct=True)


def disease_name_to_gene(quads: DataFrame | Graph, names: DataFrame, limit: int | None = None, patterns: bool = False) -> DataFrame:
    """(name, disease, gene, pmids): the names' diseases, to genes; diseases without an association are left out first; limit: rows of each name.

    pmids: the publications of all associations and interactions that lead from the one to the other, sorted and joined by a pipe.
    Where there are few different ones, sets of them are the bits of a number, over both sides of a compound's hub.
    """
    home = scratch(quads.sparkSession)
    found = named(quads, "label", names, patterns).select("name", F.col("id").alias("disease")).distinct()
    known = written(found.join(quads.where("p = 'ctd:disease'").select(F.col("o").alias("disease")), "disease", "left_semi"), f"{home}/known")
    evidence = [("?assoc", "ctd:pmids", "?own"), ("?ixn", "ctd:pubmedids", "?other")]
    own = written(bgp(quads, [*DISEASE, evidence[0]], ["compound", "disease", "own"], {"disease": known.select("disease")}, distinct=True).where("own is not null"), f"{home}/own")
    other = written(bgp(quads, [*IXN, evidence[1]], ["compound", "gene", "other"], distinct=True).where("other is not null"), f"{home}/other")
    said = [df.select(c).distinct().select(F.explode(split_multi(F.col(c))).alias("id")) for df, c in ((own, "own"), (other, "other"))]
    ids = sorted(r[0] for r in said[0].union(said[1]).distinct().limit(SET + 1).collect())
    coded = codings(own, [["disease"]]) + codings(other, [["gene"]])
    if len(ids) > SET or None in coded:
        ways = listed_join(own, other, ["compound"], ["disease", "gene", "own", "other"], f"{home}/over", stored=True)
        every = F.explode(F.concat(split_multi(F.col("own")), split_multi(F.col("other")))).alias("id")
        genes = ways.select("disease", "gene", every).groupBy("disease", "gene").agg(F.array_join(F.array_sort(F.collect_set("id")), "|").alias("pmids"))
        out = known.join(genes, "disease").select("name", "disease", "gene", "pmids")
        return limit_each(out, "name", limit) if limit else out

    def as_bits(df: DataFrame, coding: Coding, term: str, c: str) -> DataFrame:
        parts = split_multi(F.col(c))
        bits = sum([F.when(F.array_contains(parts, x), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, x in enumerate(ids)], F.lit(0).cast("long"))
        texts = written(df.select(c).distinct().withColumn("_bits", bits), f"{home}/texts-{c}")  # as a set is told once for a text, not for a fact
        return df.join(texts, c).groupBy("compound", coding.code(F.col(term)).alias(term)).agg(F.bit_or("_bits").alias(c))

    left, right = (as_bits(df, coding, term, c) for df, coding, term, c in ((own, coded[0], "disease", "own"), (other, coded[1], "gene", "other")))
    ways = listed_join(left, right, ["compound"], ["disease", "gene", "own", "other"], f"{home}/over", distinct=False)
    genes = ways.groupBy("disease", "gene").agg(F.bit_or(F.col("own").bitwiseOR(F.col("other"))).alias("_bits")).where("_bits != 0")
    asked = known.select("name", coded[0].code(F.col("disease")).alias("disease")).where("disease is not null")
    sets = F.array(*[F.when(F.col("_bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(x)) for i, x in enumerate(ids)])
    out = genes.join(asked.hint("shuffle_hash"), "disease").select("name", coded[0].text(F.col("disease")).alias("disease"), coded[1].text(F.col("gene")).alias("gene"), F.array_join(sets, "|").alias("pmids"))
    return limit_each(out, "name", limit) if limit else out


def exposure_disease(quads: DataFrame, stressors: DataFrame, object_pattern: str) -> DataFrame:
    """Stressors to the diseases of their records whose identifier matches a pattern, with the stressor's name."""
    out = bgp(quads, DISEASE + [("?compound", "label", "?stressor_name")], ["compound", "disease", "stressor_name"], {"compound": stressors}, distinct=True)
    return out.where(F.rlike("disease", F.lit(object_pattern)))


def disease_drug_pathway(quads: DataFrame, names: DataFrame, patterns: bool = False) -> DataFrame:
    """Diseases by name to drugs, genes and pathways, in the order of names."""
    asked = named(quads, "label", names, patterns).select("id")
    out = bgp(quads, DISEASE + [("?disease", "label", "?disease_name")] + DRUG + [("?drug", "drugbank:target", "?gene")] + PATHWAY, ["disease_name", "drug_name", "path_name"], {"disease": asked}, distinct=True)
    return out.orderBy("disease_name", "drug_name", "path_name")


def broader_category(broader: DataFrame, names: DataFrame) -> DataFrame:
    """(name, category, category_name) of the items (label, category, category_name) whose label contains one of the names, by name."""
    items = broader.select(F.struct("category", "category_name").alias("id"), "label")
    return containing(items, names).select("name", "id.category", "id.category_name").distinct().orderBy("name", "category_name")


def parts_of(quads: DataFrame, up: DataFrame, predicate: str, root: DataFrame) -> DataFrame:
    """(id, part, label): objects of a predicate that stand below a root (id), with their labels."""
    edges = quads.where(F.col("p") == predicate).select(F.col("s").alias("id"), F.col("o").alias("part"))
    labels = quads.where("p = 'label'").select(F.col("s").alias("part"), F.col("o").alias("label"))
    return having_ancestor(edges, up, root, "part").join(labels, "part").select("id", "part", "label").distinct()


def superclass_targets(quads: DataFrame, is_a: DataFrame, predicate: str, graph: str | None = None, up: DataFrame | None = None) -> DataFrame:
    """(id, target, label): terms, by any of their superclasses or themselves, to a predicate's objects (in one named graph, if given) and their labels.

    up: is_a's reflexive closure, where it is known.
    """
    given = quads if graph is None else quads.where(F.col("g") == graph)
    edges = given.where(F.col("p") == predicate).select(F.col("s").alias("source_id"), F.col("o").alias("target_id"))
    labels = quads.where("p = 'label'").select(F.col("s").alias("target"), F.col("o").alias("label"))
    return property_path(closure(is_a, reflexive=True) if up is None else up, edges).join(labels, "target").select("id", "target", "label")


def one_hop(edges: DataFrame, nodes: DataFrame, label: str, limit: int | None = None) -> DataFrame:
    """(id, neighbor): undirected neighbours of a type; limit: the least of each node."""
    out = neighbors(edges, nodes).where(curie_prefix(F.col("neighbor")) == label).select("id", "neighbor").distinct()
    return limit_each(out, "id", limit) if limit else out


def one_hop_of(edges: DataFrame, nodes: DataFrame, label: str, prefixes: list[str], limit: int | None = None) -> DataFrame:
    """one_hop of the nodes of some vocabularies alone."""
    return one_hop(edges, nodes.where(curie_prefix(F.col("id")).isin(prefixes)), label, limit)


def name_to_ids(concepts: DataFrame, names: DataFrame, prefix: str) -> DataFrame:
    """(name, target_id): the aliases of each name's concepts (name, aliases) that have a prefix."""
    rows = names.join(concepts, "name").select("name", F.explode("aliases").alias("target_id"))
    return rows.where(F.startswith("target_id", F.lit(f"{prefix}:"))).distinct()


def name_to_any_alias(concepts: DataFrame, names: DataFrame) -> DataFrame:
    """(name, aliases): the first match's aliases, joined."""
    first = names.join(concepts, "name").groupBy("name").agg(F.min("aliases").alias("aliases"))
    return first.select("name", F.array_join("aliases", ";").alias("aliases"))


def name_to_vocabulary(concepts: DataFrame, names: DataFrame, prefix: str, needed: str, new: str) -> DataFrame:
    """(name, target_id): aliases of a prefix, re-prefixed, of the names that have any alias of the needed prefix."""
    rows = names.join(concepts, "name").select("name", F.explode("aliases").alias("alias"))
    has = rows.groupBy("name").agg(F.bool_or(F.startswith("alias", F.lit(f"{needed}:"))).alias("has")).where("has").select("name")
    return rows.where(F.startswith("alias", F.lit(f"{prefix}:"))).join(has, "name", "left_semi").select("name", rewrite_prefix(F.col("alias"), prefix, new).alias("target_id")).distinct()


def ctd_name_to_chemical(chemicals: DataFrame, names: DataFrame) -> DataFrame:
    """(name, chemical): chemicals (name, synonyms) whose name or a synonym is the lower-cased name."""
    index = chemicals.select(F.lower("name").alias("key"), F.col("name").alias("chemical")).union(chemicals.select(F.explode(F.transform("synonyms", lambda x: F.lower(x))), "name")).distinct()
    return names.withColumn("key", F.lower("name")).join(index, "key").select("name", "chemical")


def ctd_chemical_to_gene(ixns: DataFrame, chemicals: DataFrame, organism: str) -> DataFrame:
    """(chemical, gene_id, actions, pmids): one organism's interactions of the chemicals, lists split."""
    rows = ixns.where(F.col("organism_id") == organism).join(chemicals.select("chemical").distinct(), "chemical", "left_semi")
    return rows.select("chemical", "gene_id", split_multi(F.col("actions")).alias("actions"), split_multi(F.col("pmids")).alias("pmids"))


def linked_targets(records: DataFrame, symbols: DataFrame) -> DataFrame:
    """(id, symbol): provider records' Target links to the symbols (refid, symbol) of their targets; targets without one are left out."""
    rows = records.select("id", F.explode(pick(F.col("links"), "kind", "Target", "refid")).alias("refid"))
    return rows.join(symbols, "refid").select("id", "symbol").distinct()


def target_terms(records: DataFrame, label: str) -> DataFrame:
    """(id, term): terms of the properties of a label in all links."""
    props = records.select("id", F.explode(F.flatten(F.col("links.properties"))).alias("p"))
    return props.where(F.col("p.label") == label).select("id", F.col("p.term").alias("term")).distinct()


def gene_synonyms(genes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, target_id, predicate): genes' UniProt ids as synonym edges (genes: id, uniprot_ids)."""
    return ids.join(genes, "id").select("id", F.explode("uniprot_ids").alias("u")).select("id", F.concat(F.lit("UNIPROTKB:"), "u").alias("target_id"), F.lit("synonym").alias("predicate"))


def associations(records: DataFrame, predicate: str) -> DataFrame:
    """(id, target_id, predicate, relation, pmids): associations with their PMID publications."""
    rows = records.select("id", F.explode("associations").alias("a"))
    return rows.select("id", F.col("a.object.id").alias("target_id"), F.lit(predicate).alias("predicate"), F.col("a.relation.label").alias("relation"), pmids(F.col("a.publications")).alias("pmids"))


def associations_below(edges: DataFrame, up: DataFrame, roots: DataFrame, old: str, new: str) -> DataFrame:
    """Association edges whose target stands below a root, re-prefixed."""
    return having_ancestor(edges, up, roots, "target_id").withColumn("target_id", rewrite_prefix(F.col("target_id"), old, new))


def roots_above(edges: DataFrame, up: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, target_id, matched): edges whose target stands below any of the roots, with the roots that it stands below, sorted."""
    above = up.join(roots.select(F.col("id").alias("ancestor")).distinct(), "ancestor", "left_semi").groupBy(F.col("id").alias("target_id")).agg(F.array_sort(F.collect_set("ancestor")).alias("matched"))
    return edges.select("id", "target_id").distinct().join(above, "target_id").select("id", "target_id", "matched")


def genetic_conditions(ids: DataFrame, terms: DataFrame, xrefs: DataFrame, up: DataFrame, roots: DataFrame, old: str, new: str) -> DataFrame:
    """(id, target_id): ids, resolved through cross-references where the ontology lacks them, that stand below a root, re-prefixed."""
    resolved = lookup_fallback(ids, terms, xrefs)
    return having_ancestor(resolved, up, roots, "resolved").select("id", rewrite_prefix(F.col("resolved"), old, new).alias("target_id")).distinct()


def annotation_cells(annotations: DataFrame, db: str, taxon: str) -> DataFrame:
    """(id, target_id): distinct connected references of a database in the extensions of one taxon's annotations (id, taxon, extensions(xrefs(db, id)))."""
    rows = annotations.where(F.col("taxon") == taxon).select("id", F.explode("extensions").alias("e")).select("id", F.explode("e.xrefs").alias("x"))
    return rows.where(F.col("x.db") == db).select("id", F.concat_ws(":", "x.db", "x.id").alias("target_id")).distinct()


def phenotype_to_anatomy(quads: DataFrame, is_a: DataFrame, predicate: str, part_predicate: str, root: DataFrame, graph: str | None = None) -> DataFrame:
    """(id, target, label): superclass_targets, the predicate being that of one named graph if one is given, and, besides, those targets' parts below the root."""
    up = closure(is_a, reflexive=True)
    own = written(superclass_targets(quads, is_a, predicate, graph, up), scratch(quads.sparkSession))
    parts = parts_of(quads, up.where("depth > 0"), part_predicate, root).select(F.col("id").alias("target"), F.col("part"), F.col("label").alias("part_label"))
    return own.unionByName(own.select("id", "target").join(parts, "target").select("id", F.col("part").alias("target"), F.col("part_label").alias("label"))).distinct()


def cross_ontology(relations: DataFrame, prefix: str) -> DataFrame:
    """(id, target_id, predicate): nested relations (id, relations(relation, targets)) whose target has a prefix."""
    rows = relations.select("id", F.explode("relations").alias("r")).select("id", F.col("r.relation").alias("predicate"), F.explode("r.targets").alias("target_id"))
    return rows.where(F.startswith("target_id", F.lit(f"{prefix}:"))).distinct()


def split_ids(rows: DataFrame, column: str) -> DataFrame:
    """(key, id): a comma list of identifiers as rows, trimmed and in upper case."""
    return rows.select("key", F.explode(split_multi(F.col(column), ",")).alias("id")).select("key", F.upper("id").alias("id")).distinct()


def clinical_outcome_pathway(quads: DataFrame, drugs: DataFrame, diseases: DataFrame, moves: DataFrame | None = None) -> DataFrame:
    """(program, level, source_id, predicate, target_id, type_ok): by all shortest ways of the type graph, disease names to genetic conditions and to genes, and drug names to pathways.

    drugs and diseases (id) are NAME.DRUG and NAME.DISEASE nodes.  The programs are compiled from the
    graph's own transitions (moves; default: of the quads); levels that two programs have in common are executed once.
    """
    quads = written(quads.select("s", "p", "o"), scratch(quads.sparkSession))
    moves = transitions_of(quads) if moves is None else moves
    asked = [("disease_condition", "NAME.DISEASE", "ORPHANET", diseases), ("disease_gene", "NAME.DISEASE", "GENE", diseases), ("drug_pathway", "NAME.DRUG", "PATH", drugs)]
    programs = {name: (program_of(moves, src, moves.where(F.col("dst_type") == dst).select("dst_type")), things) for name, src, dst, things in asked}
    return execute_programs(programs, quads, stored=True)
