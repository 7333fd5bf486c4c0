"""Slow and plain versions of the operators, for comparison."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import zstandard

from graphloom.llm import decontaminate, language, lines, packing, secrets, simhash


def words(text):
    return re.findall("[0-9a-z\x80-\U0010ffff]+", (text or "").lower())


def profile(text):
    """The bundled vector of a text and its number of trigrams."""
    s = " " + re.sub(r"\s+", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).lstrip() + " "
    s = re.sub(" +", " ", s)
    grams = Counter(s[i : i + 3] for i in range(len(s) - 2) if s[i + 1] != " ")
    v = np.zeros(language.DIMENSIONS)
    if grams:
        alphabet = sorted(set(s))
        letter = dict(zip(alphabet, language.letter_vectors(np.array([0 if c == " " else ord(c) for c in alphabet]))))
        for g, n in grams.items():
            a, b, c = (letter[x].astype(int) for x in g)
            v += n * a[language._PERM][language._PERM] * b[language._PERM] * c
    return v, sum(grams.values())


def known_languages(rows):
    """Ids of (doc_id, text, lang) rows that are kept; all labelled rows make the prototypes."""
    equal, pairs = 0.0, 0
    made, sums = {}, defaultdict(lambda: np.zeros(language.DIMENSIONS))
    for i, text, lang in rows:
        made[i] = v, n = profile(text)
        if lang is not None and n:
            sums[lang] += v / np.linalg.norm(v) * n**0.5
            equal += v @ v / language.DIMENSIONS - n
            pairs += n * (n - 1)
    protos, c = [p / np.linalg.norm(p) for p in sums.values()], equal / pairs
    expected = lambda n: (n * c / (n * c + 1 - c)) ** 0.5
    floor = lambda n: language.FLOOR * expected(n) - language.DEVIATIONS / language.DIMENSIONS**0.5 * (1 - expected(n))
    return {i for i, (v, n) in made.items() if n and max(v @ p for p in protos) / np.linalg.norm(v) >= floor(n)}


def dedup_lines(rows, sites=lines.SITES):
    """{doc_id: (text, removed, left)} of (doc_id, text, source) rows with distinct ids."""
    spread, first = defaultdict(set), {}
    for i, text, source in sorted(rows, key=lambda r: r[0]):
        for p, line in enumerate((text or "").split("\n")):
            line = line.strip(lines.BLANK)
            if line:
                spread[line] |= {source} - {None}
                first.setdefault(line, (i, p))
    out = {}
    for i, text, _ in rows:
        parts = (text or "").split("\n")
        keep = [x for p, x in enumerate(parts) if not x.strip(lines.BLANK) or len(spread[x.strip(lines.BLANK)]) < sites or first[x.strip(lines.BLANK)] == (i, p)]
        out[i] = ("\n".join(keep) if text is not None else None, len(parts) - len(keep), sum(1 for x in keep if x.strip(lines.BLANK)))
    return out


def near_groups(rows, distance=simhash.DISTANCE):
    """{doc_id: least id of its component} of (doc_id, text) rows, from all pairs of fingerprints."""
    ids = [i for i, _ in rows]
    prints = np.concatenate([simhash.fingerprints(pa.array([t], pa.string()))[0] for _, t in rows]).view(np.uint64)
    head = {i: i for i in ids}

    def find(x):
        while head[x] != x:
            x = head[x]
        return x

    pairs = set()
    for a in range(len(ids)):
        d = np.bitwise_count(prints[a] ^ prints[a + 1 :]).sum(1)
        for b in np.flatnonzero(d <= distance) + a + 1:
            if prints[a].any() and prints[b].any():
                pairs.add((ids[a], ids[b]))
                x, y = sorted((find(ids[a]), find(ids[b])))
                head[y] = x
    return {i: find(i) for i in ids}, pairs


def leaks(docs, items, share=decontaminate.CONTAINMENT, k=decontaminate.WORDS):
    """{(doc_id, item_id): (containment, start)}"""
    out = {}
    for item, text in items:
        w = words(text)
        n = min(k, len(w))
        own = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if w else set()
        for doc, body in docs if w else ():
            d = words(body)
            s = [tuple(d[i : i + n]) for i in range(len(d) - n + 1)]
            hits = [i for i, x in enumerate(s) if x in own]
            for i in hits:
                held = len({s[j] for j in hits if i <= j <= i + len(w) - n})
                if held >= share * len(own) and held / len(own) > out.get((doc, item), (0, 0))[0]:
                    out[doc, item] = (held / len(own), i)
    return out


def pack(lengths, tiers=packing.TIERS):
    """(tier, window, offset) of each piece, by trying everything."""
    place, free = {}, []
    for t in range(len(tiers) - 1, -1, -1):
        mine = [i for i, n in enumerate(lengths) if n <= tiers[t] and (t == 0 or n > tiers[t - 1]) and i not in place]
        here = []
        for i in sorted(mine, key=lambda i: (-lengths[i], i)):
            fits = [w for w in here if free[w] >= lengths[i]]
            if fits:
                w = min(fits, key=lambda w: (free[w], w))
            else:
                w = len(free)
                free.append(tiers[t])
                here.append(w)
            place[i] = (t, w, tiers[t] - free[w])
            free[w] -= lengths[i]
        for w in sorted(here, key=lambda w: (-free[w], -w)):
            while True:
                fits = [i for i, n in enumerate(lengths) if i not in place and n <= free[w]]
                if not fits:
                    break
                i = max(fits, key=lambda i: (lengths[i], -i))
                place[i] = (t, w, tiers[t] - free[w])
                free[w] -= lengths[i]
    return [place[i] for i in range(len(lengths))]


KEYWORDS = "token secret passwd password pwd apikey api-key api_key accesskey access-key access_key privatekey private-key private_key credential auth bearer clientkey client-key client_key signature sessionid session-id session_id".split()


def secret_places(text):
    """{(start, end)} of the candidates of a text, character by character, without patterns."""
    word = [c.isalnum() or c in "_.-" for c in text]
    runs, i = [], 0
    while i < len(text):
        if word[i]:
            j = i
            while j < len(text) and word[j]:
                j += 1
            runs.append((i, j))
            i = j
        else:
            i += 1
    names = []
    for k, (i, j) in enumerate(runs):
        said = text[i:j].lower()
        if any(x in said for x in KEYWORDS) or "passwrd" in said:
            names.append((i, j))
        elif k and said.startswith("key") and text[runs[k - 1][1] : i] == " " and text[slice(*runs[k - 1])].lower().endswith(("api", "access", "private", "client")):
            two = text[slice(*runs[k - 1])].lower()
            names.append((runs[k - 1][1] - max(len(x) for x in ("api", "access", "private", "client") if two.endswith(x)), j))
    out, bare = set(), []
    for i, j in names:
        at = j + (text[j : j + 1] in ('"', "'") and j < len(text))
        blank = at
        while blank < len(text) and text[blank].isspace():
            blank += 1
        sign = blank
        while sign < len(text) and sign < blank + 2 and text[sign] in ":=":
            sign += 1
        if sign > blank:
            sign += text[sign : sign + 1] == ">"
            at = sign
            while at < len(text) and text[at].isspace():
                at += 1
        elif blank > at:
            at = blank
        else:
            continue
        if text[at : at + 6].lower() == "bearer" and text[at + 6 : at + 7].isspace():
            at += 6
            while at < len(text) and text[at].isspace():
                at += 1
        if at < len(text) and text[at] in "\"'`":
            end = at + 1
            while end < len(text) and text[end] not in "\"'`" and not text[end].isspace():
                end += 1
            if end < len(text) and text[end] == text[at] and end - at > secrets.SHORTEST:
                out.add((at + 1, end))
                continue
        end = at
        while end < len(text) and not text[end].isspace() and text[end] not in "\"'`()[]{}<>,;":
            end += 1
        bare.append([i, at, end])
    for a, b in zip(bare, bare[1:]):
        if b[0] < a[2]:
            a[2] = max(a[1], b[0])
    out |= {(at, end) for _, at, end in bare if end - at >= secrets.SHORTEST and not secrets._wordlike(text[at:end])}
    marks = [(m.start(), m.end(), m[1]) for m in re.finditer("-----(BEGIN|END) [A-Z ]{0,40}PRIVATE KEY( BLOCK)?-----", text)]
    for (_, a, kind), (b, _, other) in zip(marks, marks[1:]):
        if (kind, other) == ("BEGIN", "END") and b > a and all(c.isalnum() or c in "_+/=:,.\\-" or c.isspace() for c in text[a:b]):
            out.add((a, b))
    return out


def secret_rows(text):
    """[(start, end)] of what is reported: candidates whose bytes zstandard cannot save, found by compressing twice."""
    found, at = [], -1
    for start, end in sorted(secret_places(text), key=lambda x: (x[0], -x[1])):
        if start < at:
            continue
        secret = text[start:end]
        around = (text[max(0, start - secrets.AROUND) : start] + " " + text[end : end + secrets.AROUND]).replace(secret, " ")
        known = zstandard.ZstdCompressionDict(secrets.IDENTIFIERS + around.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        params = zstandard.ZstdCompressionParameters.from_level(secrets.LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        size = [len(zstandard.ZstdCompressor(dict_data=known, compression_params=params).compress(x)) for x in (secret.encode(), b"")]
        if max(0, size[0] - size[1]) >= secrets.NOVELTY * secrets.random_size(secret, len(secret.encode())):
            found.append((start, end))
            at = end
    return found
