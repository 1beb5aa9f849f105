import base64
import gzip
import hashlib
import zlib

import pytest

from leafmill.llm import warc


def _record(k, digest=None, kind="response", head=b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n"):
    payload = b" ".join(hashlib.sha256(b"%d %d" % (k, j)).hexdigest().encode() for j in range(40))
    block = head + payload
    digest = digest or (lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode())
    content = b"Content-Type: application/http\r\n" if head else b""
    return b"WARC/1.0\r\nWARC-Type: %s\r\nWARC-Record-ID: <urn:%d>\r\n%sWARC-Block-Digest: %s\r\nWARC-Payload-Digest: %s\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (
        kind.encode(), k, content, digest(block).encode(), digest(payload).encode(), len(block), block)


def _ids(data):
    return [int(x[2]["record_id"][5:-1]) for x in warc.salvage(data) if isinstance(x[2], dict)]


@pytest.mark.parametrize("digest", [None, lambda x: "SHA-1:" + hashlib.sha1(x).hexdigest(), lambda x: "md5:" + hashlib.md5(x).hexdigest(), lambda x: "xyz:unknown"])
def test_records_with_usual_digests_are_read(digest):
    assert _ids(b"".join(gzip.compress(_record(k, digest)) for k in range(3))) == [0, 1, 2]
    assert _ids(gzip.compress(_record(1, digest, "resource", b""))) == [1]


def test_wrong_digests_are_gaps():
    wrong = _record(1).replace(b"200 OK", b"404 OK")
    assert [isinstance(x[2], dict) for x in warc.salvage(gzip.compress(_record(0)) + gzip.compress(wrong))] == [True, False]


def test_records_around_a_bad_one_of_the_same_member_stay():
    records = [_record(k) for k in range(6)]
    records[2] = records[2].replace(b"200 OK", b"404 OK")
    found = list(warc.salvage(gzip.compress(b"".join(records)) + gzip.compress(_record(9))))
    assert [isinstance(x[2], dict) for x in found] == [True, True, False, True, True, True, True]
    assert _ids(gzip.compress(b"".join(records))) == [0, 1, 3, 4, 5]


def test_damaged_and_truncated_members_give_what_was_unpacked():
    records = b"".join(_record(k) for k in range(60))
    whole = gzip.compress(records)
    cut = list(warc.salvage(whole[: len(whole) // 2]))
    kept = [x for x in cut if isinstance(x[2], dict)]
    assert 20 <= len(kept) <= 30 and sum(isinstance(x[2], str) for x in cut) == 1
    damaged = bytearray(whole)
    damaged[len(whole) // 2 : len(whole) // 2 + 40] = b"\xff" * 40
    ids = _ids(bytes(damaged) + gzip.compress(_record(99)))
    assert ids[-1] == 99 and ids[:20] == list(range(20)) and len(set(ids)) == len(ids)


def test_stored_members_are_not_read_twice():
    pack = zlib.compressobj(0, wbits=31)
    whole = pack.compress(b"".join(_record(k) for k in range(10))) + pack.flush()
    assert _ids(whole[:-4] + b"xxxx") == list(range(10))
