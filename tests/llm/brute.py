"""Plain answers to the contracts, for small tables: no hashing, no pruning, no automata."""

from __future__ import annotations

import hashlib
import re


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def repeats(rows, window=13):
    """(doc_id, text) rows to {doc_id: (n_words, n_removed, kept)}."""
    words = {d: re.findall(r"[^\x20\x09-\x0D]+", t or "") for d, t in rows}
    first = {}
    for d, w in words.items():
        for i in range(len(w) - window + 1):
            key = tuple(w[i : i + window])
            first[key] = min(d, first.get(key, d))
    out = {}
    for d, w in words.items():
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < d:
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def _normal(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def contamination(documents, items, window=13):
    windows = {}
    for item, text in items:
        w = _normal(text)
        size = min(window, len(w))
        for i in range(len(w) - size + 1 if size else 0):
            windows.setdefault(tuple(w[i : i + size]), set()).add(str(item))
    sizes = sorted({len(k) for k in windows})
    out = {}
    for d, text in documents:
        w, hit, found = _normal(text), set(), set()
        for size in sizes:
            for i in range(len(w) - size + 1):
                owners = windows.get(tuple(w[i : i + size]))
                if owners:
                    found |= owners
                    hit.update(range(i, i + size))
        bad = len(hit) > 0 and 20 * len(hit) >= len(w)
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bad)
    return out


def shingles(text, n=5):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


def near(rows):
    """(doc_id, text) rows to {doc_id: (n_shingles, component_id)}; every pair with a common shingle is compared."""
    sets = {d: shingles(t) for d, t in rows}
    at = {}
    for d, s in sets.items():
        for x in s:
            at.setdefault(x, []).append(d)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    seen = set()
    for docs in at.values():
        for i, a in enumerate(docs):
            for b in docs[i + 1 :]:
                if (a, b) in seen or root(a) == root(b):
                    continue
                seen.add((a, b))
                common = len(sets[a] & sets[b])
                if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                    ra, rb = root(a), root(b)
                    parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def archives(rows):
    """(page_id, html) rows to {page_id: (bytes, digest, type, refers_to)}; ids are unique here."""
    first = {}
    for page, html in rows:
        raw = (html or "").encode()
        if len(raw) >= 100:
            first[raw] = min(page, first.get(raw, page))
    out = {}
    for page, html in rows:
        raw = (html or "").encode()
        to = first.get(raw, page)
        out[page] = (len(raw), hashlib.sha256(raw).hexdigest(), "response" if to == page else "revisit", None if to == page else to)
    return out


def chats(rows):
    """(conv, turn, role, text) rows to {conv: (n_turns, turns digest, loss_chars, loss digest)}."""
    by = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0], r[1])):
        by.setdefault(conv, []).append((role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss))
    return out


def nearest(vectors, k=5):
    """{id: vector} to {query: [ids]} for the ids divisible by 50, by exact cosine."""
    import numpy as np

    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], dtype=np.float64)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    out = {}
    for at in np.flatnonzero(ids % 50 == 0):
        scores = m @ m[at]
        order = [j for j in np.lexsort((ids, -scores)) if j != at][:k]
        out[int(ids[at])] = [int(ids[j]) for j in order]
    return out


def packing_faults(rows, documents, capacity):
    """What is wrong with a packing: rows (doc_id, piece, start, n_words, bin_id, bin_offset), documents {id: (words, source, cluster)}."""
    faults, words, bins = [], {}, {}
    for doc, piece, start, n, number, at in rows:
        words.setdefault(doc, []).append((start, n))
        if number is None:
            if n:
                faults.append(("no bin", doc))
            continue
        bins.setdefault(number, []).append((at, n, doc))
    for doc, (n, _, _) in documents.items():
        end = 0
        for start, size in sorted(words.get(doc, [])):
            if start != end:
                faults.append(("gap", doc))
            end = start + size
        if end != n:
            faults.append(("words", doc, n, end))
    for number, parts in bins.items():
        end = 0
        for at, n, _ in sorted(parts):
            if at != end:
                faults.append(("offset", number))
            end = at + n
        if end > capacity:
            faults.append(("capacity", number))
        docs = [d for _, _, d in parts]
        for what in (1, 2):
            kinds = [documents[d][what] for d in docs if documents[d][what] is not None]
            if len(kinds) != len(set(kinds)):
                faults.append(("conflict", number, what))
    return faults


KINDS = ("email", "ip", "card", "phone")


def personal(text):
    """(counts by kind, digest) of the base spans of a text."""
    text = text or ""
    found = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m.group() if c in "0123456789"]
        if 12 <= len(d) <= 19 and sum(sum(divmod(2 * x, 10)) if k % 2 else x for k, x in enumerate(reversed(d))) % 10 == 0:
            found.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    found.sort()
    said = ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in found)
    return (*(sum(k == i for _, k, _ in found) for i in range(4)), sha(said)), said


def alignments(rows):
    """(doc_id, text) rows to {doc_id: (n_a, n_b, n_groups, n_links, n_best, count_sum, groups)}, token by token, with the libraries' own encoders."""
    from collections import Counter, defaultdict

    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json"), sentencepiece.SentencePieceProcessor(model_file="/opt/tokenizers/piece_bpe_32k.model")
    a.encode_special_tokens = True
    held, per = defaultdict(set), {}
    for d, text in rows:
        per[d] = (0, 0, 0, [], "")
        if not text:
            continue
        whole = f" {text}"
        enc = a.encode(whole, add_special_tokens=False)
        ids_a, ids_b = enc.ids, b.encode(text)
        # The byte length of each token: A's from its entry's letters, which stand for a byte each.
        long_a = [len(a.id_to_token(k)) for k in ids_a]
        pieces = [b.id_to_piece(k) for k in ids_b]
        bytes_b = [bytes([int(p[3:5], 16)]) if b.is_byte(k) else p.replace("\u2581", " ").encode() for k, p in zip(ids_b, pieces)]
        if sum(long_a) != len(whole.encode()) or b"".join(bytes_b) != whole.encode():
            continue
        owner_a = [i for i, n in enumerate(long_a) for _ in range(n)]
        owner_b = [i for i, t in enumerate(bytes_b) for _ in t]
        pairs = sorted(set(zip(owner_a, owner_b)))
        links = [(ids_a[i], ids_b[j]) for i, j in pairs]
        ends = lambda owners: {k + 1 for k in range(len(owners)) if k + 1 == len(owners) or owners[k] != owners[k + 1]}
        groups, start = [], 0
        for end in sorted(ends(owner_a) & ends(owner_b)):
            some = lambda ids, owners: ",".join(str(ids[i]) for i in sorted(set(owners[start:end])))  # noqa: B023, E731
            groups.append(f"{some(ids_a, owner_a)}|{some(ids_b, owner_b)}")
            start = end
        for link in links:
            held[link].add(d)
        per[d] = (len(ids_a), len(ids_b), len(groups), links, ";".join(groups))
    count = {link: len(docs) for link, docs in held.items()}
    top = Counter()
    for (x, _), n in count.items():
        top[x] = max(top[x], n)
    return {d: (na, nb, g, len(ls), sum(count[x] == top[x[0]] for x in ls), sum(count[x] for x in ls), said) for d, (na, nb, g, ls, said) in per.items()}


def trie(rows):
    """(conv, turn, role, text) rows to the nodes of the rebuilt conversations' trie, as sets of members."""
    import zlib
    from collections import defaultdict

    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(role, text) for _, _, role, text in sorted(turns)] for c, turns in by.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        paths[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return nodes_of(paths)


def nodes_of(paths):
    from collections import defaultdict

    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    out = []
    for node, of in members.items():
        below = [m for m in members if m[: len(node)] == node]
        kids = sum(len(m) == len(node) + 1 for m in below)
        leaves = sum(not any(len(o) == len(m) + 1 and o[: len(m)] == m for o in below) for m in below)
        saved = sum((len(members[m]) - 1) * len(m[-1][1].encode()) for m in below if m)
        ends = ",".join(str(c) for c in sorted(of) if len(paths[c]) == len(node))
        out.append((min(of), len(node), min(members[node[:-1]]) if node else None, len(of), kids, leaves, saved, sha(ends)))
    return sorted(out, key=repr)


def secrets(text):
    """(counts by kind, listed base spans) of a text."""
    text, found = text or "", []
    for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        found += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    for m in re.finditer("AKIA[A-Z0-9]+", text):
        found += [(m.start(), 1, m.end())] if len(m[0]) >= 18 else []
    for m in re.finditer("[0-9a-f]+", text):
        found += [(m.start(), 2, m.end())] if len(m[0]) >= 16 else []
    kinds = ("assign", "access", "hex")
    return tuple(sum(k == i for _, k, _ in found) for i in range(3)), ",".join(f"{kinds[k]}:{a}:{b}" for a, k, b in sorted(found))
