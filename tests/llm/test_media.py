import hashlib
import struct
import zlib

from memlake.llm import media

DOCS = "doc_id long, text string, feature string, n_bytes int"


def png():
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\7")) + chunk(b"IEND", b"")


GIF = b"GIF89a\x01\0\x01\0\x80\0\0\0\0\0\xff\xff\xff!\xf9\x04\0\0\0\0\0,\0\0\0\0\x01\0\x01\0\0\x02\x02D\x01\0;"
JPEG = b"\xff\xd8\xff\xe0\0\x10JFIF\0\x01\x01\0\0\x01\0\x01\0\0\xff\xda\0\x08\x01\x01\0\0?\0\xab\xff\0\xcd\xff\xd9"
PDF = b"%PDF-1.4\nxref\nstartxref\n9\n%%EOF"


def test_digest_is_an_exact_round_trip(spark):
    texts = [None, "", "a", "x" * 64, "é" * 31 + "xx", "日本\0😀" * 999, "RIFF....WAVE BM GIF89a", "z" * 300_000]
    rows = list(enumerate(texts)) + [(None, "null"), (2, "a")]
    got = media.text_media_digest(spark.createDataFrame([(*r, "f", 1) for r in rows], DOCS)).collect()
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    for i, t in rows:
        raw = (t or "").encode()
        pad = raw + b"\0" * (max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = by[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-64:]))
        assert r["media_sha256"] == hashlib.sha256(media.wav_of(pad)).hexdigest() and r["media_bytes"] == len(pad) + 44 and r["feature"].startswith("audio/wav;embedded=-;")
    assert media.text_media_digest(spark.createDataFrame([], DOCS)).count() == 0


def test_sniffing_corrects_and_carves(spark):
    wav = media.wav_of(b"sample")
    bmp = b"BM" + struct.pack("<IIIIiiHH", 58, 0, 54, 40, 1, 1, 1, 24) + b"\0" * 28
    for data, mime in ((png(), "image/png"), (GIF, "image/gif"), (JPEG, "image/jpeg"), (wav, "audio/wav"), (bmp, "image/bmp"), (PDF, "application/pdf"), (PDF + b"\n2 0 obj\nstartxref\n40\n%%EOF", "application/pdf")):
        assert media.sniff(data)[0] == (mime, 0, len(data))
        assert media.sniff(b"text " + data + b" tail")[0] == (mime, 5, 5 + len(data))
        assert not [x for x in media.sniff(data[:-1]) if x.start == 0] or data.startswith(PDF + b"\n")
    assert [(x.start, x.end) for x in media.sniff(b"%PDF-" * 3 + PDF + PDF)] == [(15, 15 + len(PDF)), (15 + len(PDF), 15 + 2 * len(PDF))]
    broken = png().replace(b"IDAT", b"IDAX")
    df = spark.createDataFrame([(1, bytearray(wav), "image/png"), (2, bytearray(b"junk" + png() + b"RIFF" + GIF), "text/plain"), (3, None, None), (4, bytearray(broken), None)], "k int, data binary, kind string")
    got = {r["k"]: r for r in media.sniff_media(df, "k", "data", "kind").collect()}
    assert (got[1]["mime"], got[2]["mime"], got[3]["mime"], got[4]["mime"]) == ("audio/wav", "text/plain", "application/octet-stream", "application/octet-stream")
    assert [(e["mime"], bytes(e["object"])) for e in got[2]["embedded"]] == [("image/png", png()), ("image/gif", GIF)]
