"""Queries of sources with structure: XML sections with inherited headings, main blocks of pages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.page_blocks import main_blocks
from ..sources.tables import table
from ..sources.writers import scratch
from ..sources.xml_context import sections


def _as_xml(spark, sf) -> str:
    """A folder of XML files with every order line as a section, under its nation, customer and order.

    Lines are written in ranges; each file opens its elements anew, and elements end where the next one differs.
    """
    nation = F.broadcast(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name"))  # 25 rows
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus", "l_quantity")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    rows = lines.join(orders, "l_orderkey").join(table(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_name"), "c_custkey").join(nation, "c_nationkey")
    keys = ["c_nationkey", "c_custkey", "l_orderkey"]
    order = [*keys, "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus"]
    path = scratch(spark, "xml-rows")
    rows.repartitionByRange(*order).withColumn("file", F.spark_partition_id()).write.parquet(path)
    w = Window.partitionBy("file").orderBy(*order)
    rows = spark.read.parquet(path)
    opens, ends = [], []
    heads = ("Chapter of {n_name}", "Subchapter &amp; {c_name}", "PART {l_orderkey} – lines")
    for k, key in enumerate(keys):
        def differs(other, n=k):
            out = F.lit(False)
            for x in keys[: n + 1]:
                out = out | ~other(x).eqNullSafe(F.col(x))
            return out

        before, after = differs(lambda x: F.lag(x).over(w)), differs(lambda x: F.lead(x).over(w))
        name = heads[k][heads[k].index("{") + 1 : heads[k].index("}")]
        a, b = heads[k].split("{" + name + "}")
        opens.append(F.when(before, F.concat(F.lit(f'<DIV{k + 3} N="'), F.col(key).cast("string"), F.lit('">\n<HEAD>' + a), F.col(name).cast("string"), F.lit(b + "</HEAD>\n"))).otherwise(""))
        ends.insert(0, F.when(after, F.lit(f"</DIV{k + 3}>\n")).otherwise(""))
    own = F.concat(F.lit('<DIV8 N="§ '), F.col("l_linenumber").cast("string"), F.lit('" TYPE="SECTION">\n<HEAD>§ '), F.col("l_linenumber").cast("string"), F.lit(" Line</HEAD>\n<P>Flag <I>"), "l_returnflag", F.lit("</I>,\n status "), "l_linestatus", F.lit("</P><P> </P><P>“"), F.col("l_quantity").cast("int").cast("string"), F.lit("”</P></DIV8>\n"))
    out = scratch(spark, "xml")
    rows.select(F.concat(*opens, own, *ends).alias("value"), "file", *order).sortWithinPartitions("file", *order).select("value").write.text(out)
    return out


def xml_sections(spark: SparkSession, sf: str) -> DataFrame:
    rows = sections(spark, _as_xml(spark, sf))
    return rows.select("chapter", "subchapter", "part", "section", "title", "text")


def page_main_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = main_blocks(table(spark, sf, "pages"), "html", ["page_id"])
    return rows.select("page_id", "tag", "main", F.round("density", 6).alias("density"))


QUERIES = {"xml_sections": xml_sections, "page_main_blocks": page_main_blocks}

ORACLE_SQL = {
    "xml_sections": """SELECT 'Chapter of ' || n_name AS chapter, 'Subchapter & ' || c_name AS subchapter, l_orderkey::VARCHAR AS part, l_linenumber::VARCHAR AS section, 'Line' AS title,
        'Flag ' || l_returnflag || ', status ' || l_linestatus || chr(10) || chr(10) || '"' || l_quantity::INT || '"' AS text
        FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey""",
}
