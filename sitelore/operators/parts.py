"""Documents of any length as ordered parts of a fixed size, without a row for a whole site."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sitelore.functions import contacts as C, text as T, vocab as V
from sitelore.functions.ranges import in_ranges, running
from sitelore.functions.scale import salted_join
from sitelore.operators.document import BOTH, CONTENTS, ORDER, no_content, section_title
from sitelore.operators.sections import RULE, first_paragraphs

PLACE = ["ord", "pos", "no"]


def document_pieces(chunks: DataFrame, contacts: DataFrame, languages: DataFrame, bases: DataFrame) -> DataFrame:
    """(site, ord, pos, no, text): what ``assemble_document`` puts together without a target, as rows in order.

    A piece is a paragraph with what stands before it, the block of contacts, a section's heading, or a
    site's opening.  Whatever is said once per site or section is joined to rows that are as few.
    """
    keys = ["site", "section"]
    paragraphs = first_paragraphs(chunks, keys)
    of_chunk = paragraphs.groupBy(*keys, "pos").agg(F.min("no").alias("first_no"))
    of_section = paragraphs.groupBy(*keys).agg(F.min("pos").alias("first_pos"))
    block = contacts.select("site", F.lit("contact").alias("section"), F.expr(C.context("emails", "phones")).alias("block"))
    number = F.create_map(*[F.lit(x) for pair in ORDER.items() for x in pair])
    present = of_section.join(block.filter("block IS NOT NULL"), keys, "full_outer").withColumn("ord", number[F.col("section")])
    lang = F.coalesce("lang", F.lit(V.DEFAULT_LANGUAGE)).alias("lang")
    sites = bases.select("site", "base_url").join(languages, "site", "left").select("site", "base_url", lang)

    before = (
        F.when(F.col("no") != F.col("first_no"), "\n").when(F.col("pos") != F.col("first_pos"), RULE).otherwise("")
    )
    body = salted_join(paragraphs.join(of_chunk, [*keys, "pos"]), of_section, keys).select(
        "site", number[F.col("section")].alias("ord"), "pos", "no", F.concat(before, "para").alias("text")
    )
    at = lambda ord_, pos: [ord_.alias("ord"), F.lit(pos).cast("bigint").alias("pos"), F.lit(0).alias("no")]
    blocks = present.filter("block IS NOT NULL").select(
        "site", *at(F.col("ord"), -1), F.when(F.col("first_pos").isNull(), F.col("block")).otherwise(F.concat("block", F.lit("\n\n"))).alias("text")
    )
    titled = present.join(sites, "site")
    headings = titled.select(
        "site", *at(F.col("ord"), -2), F.concat(F.lit("\n\n## "), F.expr(section_title("section", "lang")), F.lit("\n\n")).alias("text")
    )
    intro = paragraphs.filter(F.col("section").isin(*BOTH) & (F.col("para") != "---")).groupBy("site").agg(
        F.min_by("para", F.struct(number[F.col("section")], "pos", "no")).alias("intro")
    )
    listed = titled.groupBy("site", "lang").agg(F.array_sort(F.collect_list(F.struct("ord", "section"))).alias("s")).select(
        "site", F.expr(CONTENTS).alias("contents"),
    )
    title = F.concat(F.lit("## "), F.when(F.col("lang") == "fa", V.TOC_TITLE_FA).otherwise(V.TOC_TITLE))
    opening = sites.join(listed, "site", "left").join(intro, "site", "left").select(
        "site", *at(F.lit(-1), 0),
        F.when(F.col("contents").isNull(), no_content(F.col("base_url"))).otherwise(F.concat_ws("\n\n", "intro", title, "contents")).alias("text"),
    )
    own = body.join(sites.select("site"), "site", "left_semi")
    return opening.unionByName(headings).unionByName(blocks.join(sites.select("site"), "site", "left_semi")).unionByName(own)


def parts_of(pieces: DataFrame, size: int = V.PART_CHARS) -> DataFrame:
    """(site, part, text): the pieces of each site one after another, cut every ``size`` characters.

    Offsets are running sums over ranges, so a site of any length is spread over tasks; a piece goes to the
    parts it touches, and a part gathers at most ``size`` pieces.
    """
    ranged = in_ranges(pieces, ["site"], PLACE)
    placed = running(ranged, ["site"], PLACE, {"stop": F.length("text").cast("bigint")})
    begin = F.col("stop") - F.length("text")
    rows = placed.filter(F.length("text") > 0).select("site", "text", begin.alias("start"), "stop").select(
        "*", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("stop") - 1) / size))).alias("part")
    )
    first = F.greatest(F.col("part") * size, F.col("start"))
    length = F.least((F.col("part") + 1) * size, F.col("stop")) - first
    cut = rows.select(
        "site", F.col("part").cast("bigint").alias("part"), first.alias("first"),
        F.substring("text", (first - F.col("start") + 1).cast("int"), length.cast("int")).alias("text"),
    )
    texts = F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: x["text"])
    return cut.groupBy("site", "part").agg(F.array_join(texts, "").alias("text"))
