"""Registry ids, numbered lines, envelopes, XML and OBO records, snapshots: small files typed by hand."""

import gzip
import hashlib
import json

import pytest
from pyspark.sql import functions as F


def test_registry_ids(spark):
    from larkgraph.functions.registries import main_id, registry_ids

    cases = {
        "EudraCT 2021-002821-32": ["EUDRACT:2021-002821-32"],
        "2022-502298-41-00": ["EUCT:2022-502298-41-00"],
        "ISRCTN12345678": ["ISRCTN:12345678"],
        "DRKS00012345": ["DRKS:DRKS00012345"],
        "CTRI/2019/01/012345": ["CTRI:CTRI/2019/01/012345"],
        "IRB-2019-77": [],
        "U1111-1332-5367": [],
        "NCT01234567 / 2015-001234-12": ["NCT:NCT01234567", "EUDRACT:2015-001234-12"],
        "2015-001234-12, NCT01234567, 2015-001234-12": ["NCT:NCT01234567", "EUDRACT:2015-001234-12"],
        "\x01NCT01234567\x02ISRCTN 12345678\x01": ["NCT:NCT01234567", "ISRCTN:12345678"],
        "éNCT01234567": [],
        "": [],
        None: [],
    }
    got = spark.createDataFrame([(k,) for k in cases], "t string").select("t", registry_ids(F.col("t")).alias("ids")).collect()
    assert {r["t"]: r["ids"] for r in got} == cases
    main = {"EUCTR2021-002821-32-DE": "EUDRACT:2021-002821-32", "CTIS2022-502298-41-00": "EUCT:2022-502298-41-00", "NCT05232630": "NCT:NCT05232630", "ChiCTR2000034567": "CHICTR:ChiCTR2000034567", "EUCTR2021": None, "NCT05232630 DRKS00012345": None, "x": None, None: None}
    got = spark.createDataFrame([(k,) for k in main], "t string").select("t", main_id(F.col("t")).alias("m")).collect()
    assert {r["t"]: r["m"] for r in got} == main


def test_lines_have_the_same_numbers_however_files_are_split(spark, tmp_path):
    from larkgraph.sources.lines import json_lines, numbered, tsv_lines

    lines = [json.dumps({"id": f"r{i}", "x": "ä" * (i % 50)}, ensure_ascii=False) for i in range(4000)]
    lines[7], lines[9] = "", "with\rreturn"
    body = ("\n".join(lines) + "\n").encode()
    (tmp_path / "a.jsonl").write_bytes(body)
    (tmp_path / "b.jsonl.gz").write_bytes(gzip.compress(body))
    (tmp_path / "c.jsonl").write_bytes(gzip.compress(body))  # packed, whatever its name says
    (tmp_path / "d.gz").write_bytes(body[:-1])  # plain, and without an end of line
    (tmp_path / "_hidden").write_bytes(b"no")
    want = {(f, i + 1, x) for f in ("a.jsonl", "b.jsonl.gz", "c.jsonl", "d.gz") for i, x in enumerate(lines)}
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("7000", "128m"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            rows = numbered(spark, str(tmp_path))
            assert {(r["file"].rsplit("/", 1)[1], r["line"], r["value"]) for r in rows.collect()} == want
            if size == "7000":
                assert numbered(spark, str(tmp_path / "a.jsonl")).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    got = {r["line"]: r for r in json_lines(spark, str(tmp_path / "a.jsonl")).collect()}
    assert got[1]["id"] == "r0" and got[4000]["sha256"] == hashlib.sha256(lines[-1].encode()).hexdigest() and got[8]["id"] is None
    (tmp_path / "t.tsv").write_bytes(b"x\t1\r\ny\t2\n")
    assert [(r["id"], r["sha256"]) for r in tsv_lines(spark, str(tmp_path / "t.tsv")).orderBy("line").collect()] == [("x", hashlib.sha256(b"x\t1").hexdigest()), ("y", hashlib.sha256(b"y\t2").hexdigest())]
    with pytest.raises(FileNotFoundError):
        numbered(spark, str(tmp_path / "none"))


def test_floats_are_spelt_the_shortest_way():
    from larkgraph.sources.lines import canonical

    cases = {"1": "1", "1.0": "1.0", "-0.0": "-0.0", "0.0001": "0.0001", "0.00001": "1e-05", "1.2345678901234567e-7": "1.2345678901234566e-07", "1e15": "1000000000000000.0", "1e16": "1e+16", "1e23": "1e+23", "5e-324": "5e-324", "1.7976931348623157e308": "1.7976931348623157e+308"}
    assert {k: canonical(json.loads(k)) for k in cases} == cases
    assert canonical({"b": [1, "ä\n"], "a": None}) == '{"a":null,"b":[1,"ä\\n"]}'


def test_envelopes(spark, tmp_path):
    from larkgraph.sources.lines import canonical, envelopes

    records = [{"id": "x", "v": 1e16, "n": None}, {"v": [1, 2.50]}, "text"]
    total = hashlib.sha256(canonical(records).encode()).hexdigest()

    def write(name, **body):
        (tmp_path / name).write_text(json.dumps({"schema": "things", "version": 2, "header": {"sha256": total}, "records": records, **body}, indent=1))
        return str(tmp_path / name)

    got = envelopes(spark, write("good.json"), "things", (1, 2)).orderBy("index").collect()
    assert [(r["index"], r["id"], r["verified"]) for r in got] == [(0, "x", True), (1, None, True), (2, None, True)]
    assert got[0]["record"] == '{"id":"x","n":null,"v":1e+16}' and got[0]["sha256"] == hashlib.sha256(got[0]["record"].encode()).hexdigest()
    for bad in ({"schema": "other"}, {"version": 3}, {"header": {"sha256": "0"}}, {"records": records[:2]}):
        with pytest.raises(Exception, match="expected|checksum"):
            envelopes(spark, write("bad.json", **bad), "things", (1, 2)).collect()
    assert {r["verified"] for r in envelopes(spark, write("old.json", header={}), "things", (2,), verify=False).collect()} == {False}
    assert envelopes(spark, write("empty.json", records=[], header={}), "things", (2,), verify=False).count() == 0


XML = """<?xml version="1.0" encoding="UTF-8"?>
<JDBOR date="2024-01-01" version="1.3"><DisorderList count="3">
<Disorder id="1"><OrphaCode>58</OrphaCode><Name lang="en">Alexander &amp; others</Name><SynonymList count="1"><Synonym lang="en">AxD</Synonym></SynonymList>
 <ExternalReferenceList count="2"><ExternalReference id="9"><Source>OMIM</Source><Reference>203450</Reference><DisorderMappingRelation id="1"><Name lang="en">E (Exact mapping: the two concepts are equivalent)</Name></DisorderMappingRelation></ExternalReference>
 <ExternalReference id="8"><Source>ICD-10</Source><Reference>E75.2</Reference><DisorderMappingRelation id="2"><Name lang="en">NTBT (narrower)</Name></DisorderMappingRelation></ExternalReference></ExternalReferenceList>
 <DisorderGeneAssociationList count="1"><DisorderGeneAssociation><SourceOfValidation>1[PMID]</SourceOfValidation><Gene id="3"><Symbol>GFAP</Symbol></Gene><DisorderGeneAssociationType id="4"><Name lang="en">Disease-causing germline mutation(s) in</Name></DisorderGeneAssociationType><DisorderGeneAssociationStatus id="5"><Name lang="en">Assessed</Name></DisorderGeneAssociationStatus></DisorderGeneAssociation></DisorderGeneAssociationList>
 <PrevalenceList count="1"><Prevalence id="6"><Source>ORPHANET</Source><PrevalenceType id="1"><Name lang="en">Point prevalence</Name></PrevalenceType><PrevalenceClass id="2"><Name lang="en">&lt;1 / 1 000 000</Name></PrevalenceClass><ValMoy>0.25</ValMoy></Prevalence></PrevalenceList>
 <AverageAgeOfOnsetList count="2"><AverageAgeOfOnset id="1"><Name lang="en">Infancy</Name></AverageAgeOfOnset><AverageAgeOfOnset id="2"><Name lang="en">Adult</Name></AverageAgeOfOnset></AverageAgeOfOnsetList></Disorder>
<Disorder id="2"><Name lang="en">no code</Name></Disorder>
<Disorder id="3"><OrphaCode>61</OrphaCode><Name lang="en">bare</Name></Disorder>
</DisorderList></JDBOR>"""


def test_disorders_of_an_xml_file(spark, tmp_path):
    from larkgraph.sources.records import Disorders

    (tmp_path / "d.xml").write_text(XML)
    d = Disorders(spark, str(tmp_path / "d.xml"))
    assert {(r["id"], r["name"], tuple(r["synonyms"])) for r in d.names().collect()} == {("ORPHA:58", "Alexander & others", ("AxD",)), ("ORPHA:61", "bare", ())}
    assert {tuple(r) for r in d.references().collect()} == {("ORPHA:58", "OMIM", "203450", "E"), ("ORPHA:58", "ICD-10", "E75.2", "NTBT")}
    assert [tuple(r) for r in d.genes().collect()] == [("ORPHA:58", "GFAP", "Disease-causing germline mutation(s) in", "Assessed", "1[PMID]")]
    (p,) = d.prevalence().collect()
    assert (p["type"], p["class"], p["mean"], p["place"], p["source"]) == ("Point prevalence", "<1 / 1 000 000", 0.25, None, "ORPHANET")
    assert {r["id"]: (r["onset"], r["inheritance"]) for r in d.history().collect()} == {"ORPHA:58": (["Infancy", "Adult"], []), "ORPHA:61": ([], [])}


OBO = r'''format-version: 1.2
data-version: hp/2024-01-01

[Term]
id: HP:1
name: First: one
def: "A \"quoted\" text." [X:1]
synonym: "one" EXACT layperson [A:1, B:2]
synonym: "uno" []
synonym: "bare"
xref: UMLS:C1 {source="a", source="b"}
xref: UMLS:C2
xref: UMLS:C1 {source="c"}
is_a: HP:0 ! root
alt_id: HP:9
subset: slim "x"

[Typedef]
id: part_of
name: part of

[Term]
id: HP:2
name: old
is_obsolete: true
replaced_by: HP:1

[Term]
id: HP:2
name: new
'''


def test_stanzas_of_an_obo_file(spark, tmp_path):
    from larkgraph.sources.records import obo_header, obo_terms

    for name, text in (("a.obo", OBO), ("b.obo", OBO.replace("\n", "\r\n"))):
        (tmp_path / name).write_bytes(text.encode())
        got = {r["id"]: r for r in obo_terms(spark, str(tmp_path / name)).collect()}
        assert set(got) == {"HP:1", "HP:2"}
        one = got["HP:1"]
        assert one["name"] == "First: one" and one["definition"] == 'A "quoted" text.' and one["parents"] == ["HP:0"] and one["alt_ids"] == ["HP:9"] and one["subsets"] == ["slim"] and not one["obsolete"]
        assert [tuple(s) for s in one["synonyms"]] == [("one", "EXACT", "layperson"), ("uno", "RELATED", None), ("bare", "RELATED", None)]
        assert {x["id"]: x["sources"] for x in one["xrefs"]} == {"UMLS:C1": ["c"], "UMLS:C2": []}
        # The second stanza of an id replaces the first.
        assert got["HP:2"]["name"] == "new" and got["HP:2"]["replaced_by"] is None and not got["HP:2"]["obsolete"]
    assert {(r["tag"], r["value"]) for r in obo_header(spark, str(tmp_path / "a.obo")).collect()} == {("format-version", "1.2"), ("data-version", "hp/2024-01-01")}


def test_snapshots_are_rebuilt_only_for_a_new_input(spark, tmp_path):
    from larkgraph.sinks.snapshot import Snapshots, signature

    source = str(tmp_path / "in")
    spark.range(5).write.parquet(source)
    store, built = Snapshots(spark, str(tmp_path / "out")), []

    def build():
        built.append(1)
        return {"sums": spark.read.parquet(source).selectExpr("sum(id) AS s"), "rows": spark.read.parquet(source)}

    with pytest.raises(FileNotFoundError):
        store.load()
    assert store.fresh([source], build)["sums"].first()["s"] == 10
    group = "snapshot-idle"
    spark.sparkContext.setJobGroup(group, "an unchanged input")
    store.fresh([source], build)
    assert len(built) == 1 and not spark.sparkContext.statusTracker().getJobIdsForGroup(group)
    spark.range(5, 7).write.mode("append").parquet(source)
    old = store.load()["sums"]
    assert store.fresh([source], build)["sums"].first()["s"] == 21 and len(built) == 2
    assert old.first()["s"] == 10  # a reader of the older one goes on
    assert store.fresh([source], build, version="2")["rows"].count() == 7 and len(built) == 3
    assert signature(spark, [source]) != signature(spark, [source], "2") and signature(spark, [str(tmp_path / "none")])
    with pytest.raises(ZeroDivisionError):
        store.fresh([source], lambda: 1 / 0, version="3")
    assert store.load()["sums"].first()["s"] == 21
