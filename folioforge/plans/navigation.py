"""Queries that write conversations as structured files (one file each) and read the structures again."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import navigation
from folioforge.plans.registry import query, table
from folioforge.sources.files import Making
from folioforge.sources.syntax import Name, Stream
from folioforge.sources.writer import Builder, built, encoded


def conversation_file(turns: list[tuple[int, str, str]]) -> bytes:
    """A page for each turn with a note; outline, labels, fields and attachments name the turns."""
    b = Builder()
    tree = b.promise()
    pages = []
    for turn, role, text in turns:
        note = b.create({"Type": Name("Annot"), "Subtype": Name("StrikeOut" if role == "user" else "Text"), "Contents": encoded(role), "QuadPoints": [0] * (8 * (turn % 3))})
        pages.append(b.create({"Type": Name("Page"), "Parent": tree, "Annots": [note]}))
    b.fulfil(tree, {"Type": Name("Pages"), "Kids": pages, "Count": len(pages), "MediaBox": [0, 0, 100, 100]})
    items = [b.promise() for _ in turns]
    for k, ((turn, role, _), ref) in enumerate(zip(turns, items)):
        near = {"Prev": items[k - 1]} if k else {}
        near |= {"Next": items[k + 1]} if k + 1 < len(items) else {}
        where = {"Dest": [pages[k], Name("Fit")]} if k % 2 else {"A": {"S": Name("GoTo"), "D": [pages[k], Name("XYZ"), None, None, None]}}
        b.fulfil(ref, {"Title": encoded(f"{turn} {role}")} | near | where)
    files = []
    for turn, _, text in turns:
        data = b.create(Stream({"Type": Name("EmbeddedFile")}, text.encode()))
        files += [b"%06d.txt" % turn, b.create({"Type": Name("Filespec"), "EF": {"F": data}})]
    kids = [b.create({"Limits": [files[i], files[min(i + 14, len(files) - 2)]], "Names": files[i : i + 16]}) for i in range(0, len(files), 16)]
    parent = b.promise()
    boxes = [b.create({"T": encoded(role), "FT": Name("Tx"), "Ff": turn, "V": encoded(text[:20]), "Parent": parent}) for turn, role, text in turns]
    b.fulfil(parent, {"T": b"all", "Kids": boxes})
    root = b.create(
        {
            "Type": Name("Catalog"), "Pages": tree, "Outlines": {"First": items[0], "Last": items[-1], "Count": len(items)}, "Names": {"EmbeddedFiles": {"Kids": kids}},
            "PageLabels": {"Nums": [x for k, (turn, _, _) in enumerate(turns) for x in (k, {"S": Name("r" if turn % 2 else "D"), "P": b"p", "St": turn})]}, "AcroForm": {"Fields": [parent]},
        }
    )
    return b.save({"Root": root})


def conversation_files(spark, d) -> Making:
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("t"))

    return built(turns.select("conv_id", "t"), lambda _, t: conversation_file([(x["turn"], x["role"], x["text"]) for x in t]))


_ORD = "(row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT"


@query(f"SELECT conv_id::VARCHAR AS file_id, {_ORD} AS ord, turn || ' ' || role AS title, true AS resolved FROM conversations")
def doc_outline(spark, d):
    return navigation.outline(conversation_files(spark, d)).select("file_id", "ord", F.decode("title", "UTF-8").alias("title"), F.col("dest").isNotNull().alias("resolved"))


@query("SELECT conv_id::VARCHAR AS file_id, printf('%06d.txt', turn) AS name, md5(text) AS digest FROM conversations")
def doc_attachments(spark, d):
    return navigation.attachments(conversation_files(spark, d)).select("file_id", F.decode("name", "UTF-8").alias("name"), F.md5("data").alias("digest"))


@query(f"SELECT conv_id::VARCHAR AS file_id, {_ORD} AS first, CASE WHEN turn % 2 = 1 THEN 'r' ELSE 'D' END AS style, turn::INT AS start FROM conversations")
def doc_page_labels(spark, d):
    return navigation.page_labels(conversation_files(spark, d)).select("file_id", "first", "style", "start")


@query("SELECT conv_id::VARCHAR AS file_id, role AS name, turn::INT AS flags, 1 AS depth FROM conversations UNION ALL SELECT DISTINCT conv_id::VARCHAR, 'all', 0, 0 FROM conversations")
def doc_form_fields(spark, d):
    return navigation.fields(conversation_files(spark, d)).select("file_id", F.decode("name", "UTF-8").alias("name"), "flags", "depth")


@query(f"SELECT conv_id::VARCHAR AS file_id, {_ORD} AS page, CASE role WHEN 'user' THEN 'StrikeOut' ELSE 'Text' END AS subtype, role AS contents, (turn % 3)::INT AS quads FROM conversations")
def doc_annotations(spark, d):
    return navigation.annotations(conversation_files(spark, d)).select("file_id", "page", "subtype", F.decode("contents", "UTF-8").alias("contents"), "quads")


@query("SELECT conv_id::VARCHAR AS file_id, printf('%06d.txt', turn) AS key FROM conversations")
def doc_name_tree(spark, d):
    return navigation.name_tree(conversation_files(spark, d), "EmbeddedFiles").where("ref_id IS NOT NULL").select("file_id", F.decode("key", "UTF-8").alias("key"))


