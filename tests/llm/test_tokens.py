"""Token counts, SentencePiece coding, WARC derivatives and decontamination."""

import base64
import gzip
import hashlib
import html
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

from gazrank.llm import decontamination as D
from gazrank.llm import pieces as P
from gazrank.llm import sentencepiece_codec as S
from gazrank.llm import token_counts as C
from gazrank.llm import warc

PATH = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def model():
    return P.load(PATH)


@pytest.fixture(scope="module")
def texts(spark):
    rng = random.Random(7)
    real = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect()]
    made = ["", " ", "  a  b ", "日本語 テキスト", "x" * 300 + "\n\té", "🙂 \u0000 a", "a▁b", "aaaa" * 200, None, None, "same", "same",
            "".join(rng.choice("ab c\né日ñ<>0x") for _ in range(3000)), "".join(rng.choice("abcdefghij") for _ in range(4000))]
    return real[:60] + made


def brute(text, model):
    """Best sum of scores by the plain recurrence over the whole text."""
    table = {t: s for t, s in zip(model.text, model.score, strict=True) if t}
    t, most = P.normal(text), max(map(len, table))
    unk = min(table.values()) - P.UNK_PENALTY
    best, used = [0.0], [0]
    for end in range(1, len(t) + 1):
        top = (-np.inf, 0)
        for start in range(max(0, end - most), end):
            s, more = table.get(t[start:end]), 1
            if s is None:
                if end - start > 1:
                    continue
                s, more = unk, len(t[start].encode())
            if best[start] + s > top[0]:
                top = best[start] + s, used[start] + more
        best.append(top[0])
        used.append(top[1])
    return used[-1], best[-1]


def test_token_counts_against_whole_text_recurrence(spark, model, texts):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_tokens string")
    out = {r.doc_id: r for r in C.count_tokens(docs, model).collect()}
    for i, t in enumerate(texts):
        n, score = brute(t, model)
        # Sums beyond 2**53 ulp differ in order only; -1e9 scores make ties of long sums impossible to compare exactly.
        assert out[i].n_tokens == n and out[i].score == pytest.approx(score, rel=1e-12)
    assert C.count_tokens(docs.limit(0), model).count() == 0


def test_sentencepiece_ids_are_the_librarys(spark, model, texts):
    lib = sentencepiece.SentencePieceProcessor(model_file=PATH)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    coded = S.encode(docs, model)
    assert coded.columns == ["doc_id", "text", "ids"]
    back = S.decode(coded, model).collect()
    for r in back:
        want = lib.encode(r.text or "")
        assert r.ids == want
        assert r.decoded == lib.decode(want)
    checks = {r.doc_id: r for r in S.encode(docs, model, keep=["doc_id"], check=True).collect()}
    for i, t in enumerate(texts):
        assert checks[i].round_trip == ("▁" not in (t or ""))
        assert checks[i].ids_sha256 == hashlib.sha256(np.array(lib.encode(t or ""), "<i4").tobytes()).hexdigest()
    assert S.encode(docs.limit(0), model).count() == 0


def test_unigram_models_take_the_best_path(model, texts):
    uni = P.Pieces(model.text, [s if s is None else -float(len(t)) ** 0.5 for s, t in zip(model.score, model.text, strict=True)],
                   model.byte, model.unk, True)
    m, table = S.Matcher(uni), {t: s for t, s in zip(uni.text, uni.score, strict=True) if t}
    units, _, _ = P.split([t for t in texts if t], re.compile(uni.unit_pattern(), re.S))
    units = units[:400] + [u for u in units if len(u) > 64]
    ids, counts = S.encode_units(units, m)
    at, unk, look = 0, min(table.values()) - P.UNK_PENALTY, C.Lookup(uni)
    for u, n in zip(units, counts.tolist(), strict=True):
        got = [uni.text[i] for i in ids[at:at + n]]
        at += n
        score = C.path_counts(u, table, look, True)[1]
        if None not in got:
            assert "".join(got) == u and sum(table[p] for p in got) == pytest.approx(score)
    assert unk < 0


class Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.silent = [], 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in warc.SILENT
        self.out.append("\n" if tag in warc.BLOCK else "")

    def handle_endtag(self, tag):
        self.silent -= tag in warc.SILENT and self.silent > 0
        self.out.append("\n" if tag in warc.BLOCK else "")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(re.sub(r"[\n\r]", " ", data))


def test_plain_text_against_a_parser(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(30).collect():
        p = Text()
        p.feed(r.html)
        lines = [" ".join(x.split()) for x in "".join(p.out).split("\n")]
        got = [" ".join(x.split()) for x in warc.plain_text(r.html).split("\n")]
        assert got == [x for x in lines if x]
    assert warc.plain_text("<p>a&amp;b<br>c <!-- <p>no --> d<script>if (a<b) x()</script><b") == "a&b\nc d"


def test_warc_records_link_and_parse(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<title>T &lt;</title><p>Hi <a href='/x'>é</a>"), (2, None, None), (1, "http://a/", "<title>T &lt;</title><p>Hi <a href='/x'>é</a>")],
                                  "page_id long, url string, html string")
    source = warc.responses(pages, F.lit("2024-01-01T00:00:00Z")).withColumn("text", F.lit("clash"))
    made = warc.derivatives(source)
    rows = made.orderBy("source_key").collect()
    assert rows[0] == rows[1] and rows[0].text == "Hi é" and rows[2].text == "" and rows[0].n_links == 1
    for r in rows:
        block = r.http_block.encode()
        payload = r.http_block.partition("\r\n\r\n")[2].encode()
        for data, want in ((block, r.source_block_digest), (payload, r.source_payload_digest)):
            assert want == "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()
        for raw, kind in ((r.conversion_record, "conversion"), (r.metadata_record, "metadata")):
            head, _, rest = bytes(raw).partition(b"\r\n\r\n")
            fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
            body = rest[:-4]
            assert fields["WARC-Type"] == kind and fields["WARC-Refers-To"] == r.record_id == r.refers_to
            assert int(fields["Content-Length"]) == len(body) and fields["WARC-Block-Digest"] == warc.digest(body)
        assert f"source-WARC-Record-ID: {r.record_id}" in r.metadata and "http-header-content-type: text/html" in r.metadata
    assert "title: T <\r\n" in rows[0].metadata and "outlink: /x\r\n" in rows[0].metadata
    warc.write_warc(made, str(tmp_path / "w"))
    data = b"".join(gzip.decompress(f.read_bytes()) for f in sorted((tmp_path / "w").glob("part-*.gz")))
    assert data.count(b"WARC/1.1\r\n") == 6 and sum(len(r.conversion_record) + len(r.metadata_record) for r in rows) == len(data)
    assert warc.derivatives(source.limit(0)).count() == 0
    assert html.unescape("&amp;") == "&"


ITEMS = [
    (1, "Anna has 12 apples and gives 5 apples to Tom before she walks 3 km home with the rest of them."),
    (2, "the quick brown fox jumps over the lazy dog while seven wise men watch from afar in silence"),
    (3, "only six words are here now"),
    (4, None), (5, ""), (6, "two words"), (2, "the quick brown fox jumps over the lazy dog while seven wise men watch from afar in silence"),
]
CHANGED = "anna has 7 apples and gives".replace("anna", "Maria") + " 2 apples to Ben before she walks 9 miles home with the rest of them."
MIXED = "Maria has 7 apples and gives 7 apples to Maria before she walks 9 miles home with the rest of them."


def test_decontamination(spark):
    docs = spark.createDataFrame([
        (10, "Some intro. " + ITEMS[0][1] + " Some outro.", "c"), (11, "Start. " + CHANGED + " End", "c"), (12, MIXED, "c"),
        (13, ITEMS[1][1].upper().lower().replace(" ", "\n"), "c"), (14, "the quick brown fox jumps over the lazy cat", "c"),
        (15, "here only six words are here now ok", "c"), (16, None, "c"), (17, "", "c"), (None, ITEMS[1][1], "c"),
        (13, ITEMS[1][1].replace(" ", "\n"), "c"), (18, "two words " * 40, "c")], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(*x, "e") for x in ITEMS], "item_id long, text string, w string")
    for most in (4_000_000, 0):  # with the items' hashes in the tasks, and by the join alone
        got = {(r.doc_id, r.item_id): r for r in D.find_leaks(docs, items, max_broadcast=most).collect()}
        assert set(got) == {(10, 1), (11, 1), (13, 2), (15, 3), (None, 2)}
        assert got[10, 1].n_changed == 0 and got[11, 1].n_changed >= 5
        # 12 -> 7 and 5 -> 7: two values became one, so the parameters do not fit.
    left = sorted(r.doc_id for r in D.drop_leaks(docs, items).collect())
    assert left == [12, 14, 16, 17, 18]
    assert D.find_leaks(docs.limit(0), items).count() == 0
    assert D.find_leaks(docs, items.limit(0)).count() == 0


def test_items_of_slots_only(spark):
    # Numbers, names and capitals leave no template window; the copies are verbatim but for their case.
    texts = ["12 7 19 44 3 81 26 5 90 17 33 8 61 2", "Anna Bella Carla Dora Emma Fiona Greta Hanna Ida Julia Karla Lena Mona Nora",
             "WHICH OF THESE RIVERS FLOWS THROUGH THE OLD TOWN BEFORE IT REACHES THE SEA", "4 8 15 16 23 42"]
    items = spark.createDataFrame(list(enumerate(texts)), "item_id long, text string")
    docs = spark.createDataFrame([(i, f"some words before {t.lower()} and some after") for i, t in enumerate(texts)]
                                 + [(9, "some words and 12 7 19 and 4 8 15 16 23 only")], "doc_id long, text string")
    for most in (4_000_000, 0):
        got = {(r.doc_id, r.item_id): r for r in D.find_leaks(docs, items, max_broadcast=most).collect()}
        assert set(got) == {(0, 0), (1, 1), (2, 2), (3, 3)}
        assert all(r.n_tokens == r.item_tokens and r.n_changed == 0 for r in got.values())


def test_one_slot_that_disagrees(spark):
    item = ("The clerk had 12 boxes and the clerk put 12 more boxes beside them until the shelf in the hall was full "
            "and then 30 boxes were carried down to the yard behind the house where nobody looked for them")
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([
        (1, item.replace("put 12 more", "put 13 more")),  # one of two equal values
        (2, item.replace("had 12", "had 30").replace("put 12", "put 30")),  # 12 became the value that stands for 30
        (3, item.replace("12", "7").replace("30", "9")),
        (4, item.replace("The clerk had 12", "A clerk had 15"))], "doc_id long, text string")
    got = {r.doc_id: r for r in D.find_leaks(docs, items).collect()}
    assert set(got) == {1, 2, 3, 4}
    n = len(item.split())
    assert (got[1].n_tokens, got[1].n_changed) == (n - 1, 1) and (got[2].n_tokens, got[2].n_changed) == (n - 2, 2)
    assert (got[3].n_tokens, got[3].n_changed) == (n, 3) and got[4].n_tokens >= n - 2


def test_warc_bytes_charsets_and_headers(spark):
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html%s\r\nX-Caf\xe9: 1\r\n\r\n"
    blocks = [head % b"; charset=ISO-8859-1" + b"<p>caf\xe9", head % b"" + b"<meta charset='latin-1'><p>caf\xe9",
              head % b"" + b"<p>caf\xe9 \xff", head % b"; charset=nonsense" + "<p>café".encode(), head % b"" + "\ufeff<p>café".encode("utf-16-le"),
              b"\x00\xff", None, b"HTTP/1.1 204 No Content", head % b"" + b"<p>" + b"word " * 400_000]
    rows = [(i, f"<urn:{i}>", "http://a", "2024", b, {"WARC-IP-Address": "1.2.3.4", "WARC-Truncated": None, "WARC-Date": "given"} if i % 2 == 0 else None)
            for i, b in enumerate(blocks)]
    df = spark.createDataFrame(rows, "n long, record_id string, target_uri string, date string, http_block binary, own map<string,string>")
    got = {r.n: r for r in warc.derivatives(df, headers="own").collect()}
    texts = [got[i].text for i in range(7)]
    assert texts == ["café", "café", "caf� �", "café", "café", "\x00�", ""]
    assert len(got[8].text) == 400_000 * 5 - 1
    for i, b in enumerate(blocks):
        raw = b or b""
        assert got[i].source_block_digest == warc.digest(raw)
        assert got[i].source_payload_digest == warc.digest(raw.split(b"\r\n\r\n", 1)[-1] if b"\r\n\r\n" in raw else b"" if raw[:4] == b"HTTP" else raw)
        lines = got[i].metadata.split("\r\n")
        assert ("source-WARC-IP-Address: 1.2.3.4" in lines) == (i % 2 == 0) and ("source-WARC-Truncated: " in lines) == (i % 2 == 0)
        assert ("source-WARC-Date: given" in lines) == (i % 2 == 0) and ("source-WARC-Date: 2024" in lines) == (i % 2 == 1)
