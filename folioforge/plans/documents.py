"""Queries that write tables as document files and read them again, and codec round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import codecs, crypt, text
from folioforge.operators import content, graph, records
from folioforge.plans.registry import query, table
from folioforge.sources import files, writer

_DIGEST = "SELECT doc_id, md5(text) AS digest, length(text)::BIGINT AS chars FROM documents"


def _round(spark, d, there, back):
    data = codecs.bytes_udf(lambda b: back(there(b)))(F.encode("text", "UTF-8"))
    done = table(spark, d, "documents").select("doc_id", F.decode(data, "UTF-8").alias("t"))
    return done.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("long").alias("chars"))


@query(_DIGEST)
def codec_a85_roundtrip(spark, d):
    return _round(spark, d, codecs.a85_encode, codecs.a85_decode)


@query(_DIGEST)
def codec_flate_roundtrip(spark, d):
    return _round(spark, d, codecs.flate_encode, codecs.flate_decode)


@query(_DIGEST)
def codec_lzw_roundtrip(spark, d):
    return _round(spark, d, codecs.lzw_encode, codecs.lzw_decode)


@query(_DIGEST)
def codec_predictor_roundtrip(spark, d):
    return _round(spark, d, lambda b: codecs.predictor_rows(b, 60, 3, False, bytes(range(5))), lambda b: codecs.predictor_rows(b, 60, 3, True))


@query(_DIGEST)
def codec_filter_chain(spark, d):
    names = ("FlateDecode", "LZWDecode", "ASCII85Decode", "ASCIIHexDecode")

    def there(b):
        for n in names:
            b = codecs.encode(b, n)
        return b

    return _round(spark, d, there, lambda b: codecs.decode_chain(b, [(n, {}) for n in reversed(names)]))


@query(_DIGEST)
def codec_rle_decode(spark, d):
    runs = lambda b: b"".join(bytes([len(b[i : i + 128]) - 1]) + b[i : i + 128] for i in range(0, len(b), 128)) + b"\x80"
    return _round(spark, d, runs, codecs.rle_decode)


@query("SELECT doc_id, md5(text) AS digest, CASE WHEN regexp_full_match(text, '[ -~]*') THEN strlen(text) ELSE NULL END AS ascii_bytes FROM documents")
def text_encode_pdf(spark, d):
    e = text.encode_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.md5(text.decode_text(e)).alias("digest"), F.when(F.hex(F.substring(e, 1, 2)) != "FEFF", F.octet_length(e)).cast("long").alias("ascii_bytes"))


def _files(spark, d, packed=False):
    return writer.documents_to_files(files.spread(table(spark, d, "documents").select("doc_id", "text")), packed=packed)


def _contents(made):
    return files.streams(made, want=("decoded",), kind=None)


_LINES = "SELECT doc_id::VARCHAR AS file_id, md5(text) AS digest, len(string_split(text, chr(10)))::BIGINT AS lines FROM documents"


def _text_of(made):
    ops = content.content_ops(content.content_streams(_contents(made))).where("variant = 'TextDraw'")
    line = ops.select("file_id", "ord", text.decode_text(F.col("bytes")).alias("line"))
    rows = line.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("ord", "line"))).alias("l"))
    return rows.select("file_id", F.md5(F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("digest"), F.size("l").cast("long").alias("lines"))


@query(_LINES)
def doc_roundtrip_text(spark, d):
    return _text_of(_files(spark, d))


@query(_LINES)
def doc_rebuild(spark, d):
    return _text_of(writer.revised(_files(spark, d, True), writer.rebuilt).drop("error_code"))


@query("SELECT doc_id::VARCHAR AS file_id, 1::BIGINT AS pages FROM documents")
def doc_objstm_roundtrip(spark, d):
    return records.view(files.nodes(_files(spark, d, True)), "Page").groupBy("file_id").agg(F.count("*").alias("pages"))


@query("SELECT doc_id::VARCHAR AS file_id, doc_id::VARCHAR AS title, length(text)::VARCHAR AS keywords FROM documents")
def doc_info(spark, d):
    info = records.view(files.nodes(_files(spark, d)), "Info").where("Title IS NOT NULL")
    return info.select("file_id", F.decode("Title", "UTF-8").alias("title"), F.decode("Keywords", "UTF-8").alias("keywords"))


def _edit(f):
    b = writer.Builder(f)
    b.update(f.trailer["Info"], {"Author": b"editor"}, merge=True)
    return b.save({"Root": f.trailer["Root"], "Info": f.trailer["Info"]})


@query("SELECT doc_id::VARCHAR AS file_id, doc_id::VARCHAR AS title, 'editor' AS author FROM documents")
def doc_incremental_update(spark, d):
    made = writer.revised(_files(spark, d), _edit).drop("error_code")
    return records.view(files.nodes(made), "Info").where("Author IS NOT NULL").select("file_id", F.decode("Title", "UTF-8").alias("title"), F.decode("Author", "UTF-8").alias("author"))


@query("SELECT doc_id::VARCHAR AS file_id, 2::BIGINT AS revisions, 8::BIGINT AS entries FROM documents")
def doc_xref_revisions(spark, d):
    raw = files.xref_raw(writer.revised(_files(spark, d), _edit).drop("error_code"))
    return raw.groupBy("file_id").agg(F.countDistinct("rev").alias("revisions"), F.count("*").alias("entries"))


def _carry(f):
    b = writer.Builder()
    root = f.resolve(f.trailer["Root"])
    known = writer.imported(f, [root["Pages"]], b)
    return b.save({"Root": b.create({"Type": writer.Name("Catalog"), "Pages": known[root["Pages"].id]})})


@query(_LINES)
def doc_import_page(spark, d):
    return _text_of(writer.revised(_files(spark, d), _carry).drop("error_code"))


@query("SELECT variant, count(*) AS n FROM (SELECT unnest(['BeginText', 'TextFont', 'Leading', 'MoveTextPosition', 'EndText']) AS variant FROM documents UNION ALL SELECT unnest(['TextDraw', 'TextNewline']) FROM (SELECT unnest(string_split(text, chr(10))) FROM documents)) GROUP BY variant")
def ops_count_by_variant(spark, d):
    return content.content_ops(content.content_streams(_contents(_files(spark, d)))).groupBy("variant").agg(F.count("*").alias("n"))


@query("SELECT doc_id::VARCHAR AS file_id, true AS same FROM documents")
def ops_serialize_fusion(spark, d):
    @F.pandas_udf("boolean")
    def same(s):
        def one(b):
            ops = [o[1:] for o in content.parse_ops(bytes(b))]
            return ops == [o[1:] for o in content.parse_ops(content.serialize_ops(ops))]

        return s.map(one)

    return content.content_streams(_contents(_files(spark, d))).select("file_id", same("decoded").alias("same"))


@query("SELECT doc_id, true AS failed FROM documents")
def doc_errors_as_rows(spark, d):
    """Files cut short give error rows, not failed jobs."""
    cut = _files(spark, d).withColumn("content", F.expr("substring(content, 1, 40)"))
    return files.nodes(cut).where("error_code IS NOT NULL").select(F.col("file_id").cast("long").alias("doc_id"), F.lit(True).alias("failed"))
