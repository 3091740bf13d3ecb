"""Records that are longer than a line: XML elements and OBO stanzas, read by their delimiters so that files can be split."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Scopes of a synonym; any other is RELATED.
SCOPES = ("EXACT", "BROAD", "NARROW", "RELATED")
# The elements of a disorder that are read; names may come with a language.
_NAME = "struct<_VALUE:string,_lang:string>"
_NAMED = f"struct<Name:{_NAME}>"
DISORDER = f"""OrphaCode string, Name {_NAME}, ExpertLink struct<_VALUE:string,_lang:string>,
    SynonymList struct<Synonym:array<{_NAME}>>,
    ExternalReferenceList struct<ExternalReference:array<struct<Source:string,Reference:string,DisorderMappingRelation:{_NAMED},DisorderMappingValidationStatus:{_NAMED}>>>,
    DisorderGeneAssociationList struct<DisorderGeneAssociation:array<struct<SourceOfValidation:string,Gene:struct<Symbol:string,Name:{_NAME}>,DisorderGeneAssociationType:{_NAMED},DisorderGeneAssociationStatus:{_NAMED}>>>,
    PrevalenceList struct<Prevalence:array<struct<Source:string,PrevalenceType:{_NAMED},PrevalenceQualification:{_NAMED},PrevalenceClass:{_NAMED},ValMoy:string,PrevalenceGeographic:{_NAMED},PrevalenceValidationStatus:{_NAMED}>>>,
    AverageAgeOfOnsetList struct<AverageAgeOfOnset:array<{_NAMED}>>,
    TypeOfInheritanceList struct<TypeOfInheritance:array<{_NAMED}>>"""


def xml_rows(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    """One row for each element ``tag``; attributes are columns that begin with ``_``, the text beside them is ``_VALUE``."""
    return spark.read.format("xml").option("rowTag", tag).option("attributePrefix", "_").option("valueTag", "_VALUE").schema(schema).load(path)


class Disorders:
    """The four products of a disorder file; disorders without a code are passed over."""

    def __init__(self, spark: SparkSession, path: str):
        self.rows = xml_rows(spark, path, "Disorder", DISORDER).where("OrphaCode IS NOT NULL").withColumn("id", F.concat(F.lit("ORPHA:"), F.trim("OrphaCode")))

    def _each(self, items: str) -> DataFrame:
        return self.rows.select("id", F.explode(items).alias("x"))

    def names(self) -> DataFrame:
        return self.rows.select("id", F.col("Name._VALUE").alias("name"), F.coalesce(F.transform("SynonymList.Synonym", lambda s: s["_VALUE"]), F.array().cast("array<string>")).alias("synonyms"))

    def references(self) -> DataFrame:
        """(id, source, reference, relation): the relation is what stands before its explanation, as E in ``E (Exact mapping)``."""
        relation = F.trim(F.substring_index("x.DisorderMappingRelation.Name._VALUE", "(", 1))
        return self._each("ExternalReferenceList.ExternalReference").select("id", F.col("x.Source").alias("source"), F.col("x.Reference").alias("reference"), relation.alias("relation"))

    def genes(self) -> DataFrame:
        return self._each("DisorderGeneAssociationList.DisorderGeneAssociation").select("id", F.col("x.Gene.Symbol").alias("symbol"), F.col("x.DisorderGeneAssociationType.Name._VALUE").alias("association"), F.col("x.DisorderGeneAssociationStatus.Name._VALUE").alias("status"), F.col("x.SourceOfValidation").alias("source"))

    def prevalence(self) -> DataFrame:
        named = lambda f, c: F.col(f"x.{f}.Name._VALUE").alias(c)
        return self._each("PrevalenceList.Prevalence").select("id", named("PrevalenceType", "type"), named("PrevalenceQualification", "qualification"), named("PrevalenceClass", "class"), F.expr("try_cast(x.ValMoy AS double)").alias("mean"), named("PrevalenceGeographic", "place"), named("PrevalenceValidationStatus", "status"), F.col("x.Source").alias("source"))

    def history(self) -> DataFrame:
        """(id, onset, inheritance): names in the order of the file."""
        listed = lambda c: F.coalesce(F.transform(c, lambda x: x["Name"]["_VALUE"]), F.array().cast("array<string>"))
        return self.rows.select("id", listed("AverageAgeOfOnsetList.AverageAgeOfOnset").alias("onset"), listed("TypeOfInheritanceList.TypeOfInheritance").alias("inheritance"))


def _value(line: Column) -> Column:
    return F.regexp_replace(line, "^[^:]*: ?", "")


def _unquoted(value: Column) -> Column:
    """STRUCT<text, rest> of ``"text" rest``; without quotes all is text."""
    quoted = r'^"((?:[^"\\]|\\.)*)"\s*(.*)$'
    hit = value.rlike(quoted)
    text = F.regexp_replace(F.regexp_extract(value, quoted, 1), r'\\"', '"')
    return F.struct(F.when(hit, text).otherwise(value).alias("text"), F.when(hit, F.regexp_extract(value, quoted, 2)).otherwise("").alias("rest"))


def _first_word(value: Column) -> Column:
    return F.substring_index(value, " ", 1)


def obo_header(spark: SparkSession, path: str) -> DataFrame:
    """(file, tag, value) of what stands before the first stanza."""
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value", F.monotonically_increasing_id().alias("at"))
    head = stanzas.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("value")).where(~F.col("value").startswith("["))
    lines = head.select("file", F.posexplode(F.split("value", "\r?\n")).alias("i", "l")).where(F.contains("l", F.lit(": ")))
    return lines.select("file", F.substring_index("l", ": ", 1).alias("tag"), _value(F.col("l")).alias("value"))


def obo_terms(spark: SparkSession, path: str) -> DataFrame:
    """id, name, definition, synonyms, parents, xrefs, alt_ids, subsets, obsolete, replaced_by of the ``[Term]`` stanzas.

    Stanzas are cut where a line begins with a bracket. Other stanzas are passed over; an id that comes again replaces the term.
    A synonym without a known scope is RELATED; an xref that comes again has the sources of its last line.
    """
    stanzas = spark.read.option("lineSep", "\n[").text(path).select(F.regexp_replace("value", "^\\[", "").alias("value"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    # A stanza is one term for each line with an id.
    parts = stanzas.where(F.col("value").rlike("^Term\\]\\r?(\\n|$)")).select("file", "block", "at", F.posexplode(F.split("value", "\n(?=id: )")).alias("i", "part")).where(F.col("part").startswith("id: "))
    lines = F.transform(F.split("part", "\r?\n"), lambda l: F.struct(F.substring_index(l, ": ", 1).alias("tag"), _value(l).alias("value")))
    rows = parts.select("file", "block", "at", "i", F.filter(lines, lambda l: l["value"] != "").alias("lines"))

    def of(tag: str) -> Column:
        return F.transform(F.filter("lines", lambda l: l["tag"] == tag), lambda l: l["value"])

    def last(tag: str) -> Column:
        return F.try_element_at(of(tag), F.lit(-1))

    def synonym(value: Column) -> Column:
        whole = _unquoted(value)
        tokens = F.split(whole["rest"], " ")
        scope, kind = F.get(tokens, 0), F.get(tokens, 1)
        return F.struct(whole["text"].alias("text"), F.when(scope.isin(*SCOPES), scope).otherwise("RELATED").alias("scope"), F.when(~kind.startswith("["), kind).alias("kind"))

    xref = F.transform(of("xref"), lambda v: F.struct(_first_word(v).alias("id"), F.regexp_extract_all(v, F.lit('source="([^"]*)"'), F.lit(1)).alias("sources")))
    rows = rows.select("file", "block", "at", "i", F.try_element_at(of("id"), F.lit(1)).alias("id"), "lines", xref.alias("x"))
    xrefs = F.transform(F.array_distinct(F.transform("x", lambda x: x["id"])), lambda i: F.element_at(F.filter("x", lambda x: x["id"] == i), -1))
    term = F.struct(
        last("name").alias("name"),
        _unquoted(last("def"))["text"].alias("definition"),
        F.transform(of("synonym"), synonym).alias("synonyms"),
        F.transform(of("is_a"), _first_word).alias("parents"),
        xrefs.alias("xrefs"),
        of("alt_id").alias("alt_ids"),
        F.transform(of("subset"), _first_word).alias("subsets"),
        F.coalesce(last("is_obsolete") == "true", F.lit(False)).alias("obsolete"),
        last("replaced_by").alias("replaced_by"),
    )
    return rows.groupBy("id").agg(F.max_by(term, F.struct("file", "block", "at", "i")).alias("t")).select("id", "t.*")
