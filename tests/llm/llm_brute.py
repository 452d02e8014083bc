"""Plain versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")
FOLD = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def words(text):
    return WORD.findall((text or "").encode().translate(FOLD))


def shingles(text, k=5):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(max(len(w) - k + 1, 1))} if w else set()


def components(rows):
    """``(id, text) -> (n_shingles, component, kept)``, rows by place."""
    sets = [shingles(t) for _, t in rows]
    owners = defaultdict(set)
    for i, s in enumerate(sets):
        for x in s:
            owners[x].add(i)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, s in enumerate(sets):
        for j in set().union(*(owners[x] for x in s)) if s else ():
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    out = []
    for i, (doc, _) in enumerate(rows):
        name = least.get(find(i))
        out.append((doc, len(sets[i]), name, name is None or doc == name))
    return out


def repeats(rows, span=400):
    data = [(r[0], (r[1] or "").encode()) for r in rows]
    seen = Counter(b[i:i + span] for _, b in data for i in range(len(b) - span + 1))
    out = []
    for doc, b in data:
        runs = []
        for i in range(len(b) - span + 1):
            if seen[b[i:i + span]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + span
                else:
                    runs.append([i, i + span])
        rest = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in runs)], [*(s for s, _ in runs), len(b)]))
        out.append((doc, len(b), len(b) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()))
    return out


def quality_counts(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(zip(w, w[1:], w[2:]))
    covered = {i + d for i in range(len(w) - 2) if windows[tuple(w[i:i + 3])] > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def base_scores(rows):
    """Contracted columns of the language-model query, by place."""
    held = lambda doc: doc is None or zlib.crc32(str(doc).encode()) % 10 == 0
    tokens = lambda text: [*words(text), b" "]
    counts = Counter(w for doc, text in rows if not held(doc) for w in tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for doc, text in rows:
        t = tokens(text)
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((doc, held(doc), len(t), sum(counts[w] > 0 for w in t), n, base))
    return out


def fullest(equal, min_share=0.75):
    """Most equal words of any stretch that has the share."""
    return max((sum(equal[i:j]) for i in range(len(equal)) for j in range(i + 1, len(equal) + 1)
                if sum(equal[i:j]) >= min_share * (j - i)), default=0)


def overlaps(rows, items, min_words=8, min_share=0.75, min_item=5):
    """Most equal words of any stretch with the share, of every document with every item over all shifts: ``{(doc, item): words}``.

    A shift with fewer equal words than any such stretch needs is passed over.
    """
    out, places = {}, defaultdict(list)
    asked = [(item, words(text)) for item, text in items]
    for k, (_, other) in enumerate(asked):
        if len(other) >= min_item:
            for i, w in enumerate(other):
                places[w].append((k, i))
    for doc, text in rows:
        own = words(text)
        shifts = Counter((k, p - i) for p, w in enumerate(own) for k, i in places.get(w, ()))
        for (k, shift), n in shifts.items():
            item, other = asked[k]
            enough = min(min_words, len(other))
            if n >= enough:
                best = fullest([own[shift + i] == w for i, w in enumerate(other) if 0 <= shift + i < len(own)], min_share)
                if best >= enough:
                    out[doc, item] = max(best, out.get((doc, item), 0))
    return out


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host):]).group()
    return host.translate({c: c + 32 for c in range(65, 91)}), path


def url_rule(host, path, rules):
    fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return max(fits, key=lambda r: len(r.name), default=None)


UNITS = re.compile("[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def middles(docs, seed, percent, spm_percent):
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of each document, cut as a list of units."""
    for doc_id, text in docs:
        text = text or ""
        units = UNITS.findall(text)
        n = len(units)
        h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
        h = [int(h[8 * i:8 * i + 8], 16) for i in range(4)]
        if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
            yield doc_id, n, "plain", None, None, text
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        prefix, middle, suffix = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
        spm = h[3] % 100 < spm_percent
        output = f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"
        yield doc_id, n, "spm" if spm else "psm", len(prefix), len(middle), output


def seats_one_by_one(shares, caps, seats):
    """Sainte-Laguë: each seat to the highest quotient, the first of equals."""
    won = [0] * len(shares)
    for _ in range(min(seats, sum(c for s, c in zip(shares, caps) if s > 0))):
        open_ = [i for i in range(len(shares)) if shares[i] > 0 and won[i] < caps[i]]
        won[max(open_, key=lambda i: (shares[i] / (2 * won[i] + 1), -i))] += 1
    return won


def level_targets(sizes, weights, repeats):
    """Targets by resharing what is over a cap until none is."""
    target, free, rest = [0.0] * len(sizes), set(range(len(sizes))), sum(sizes)
    while free:
        level = rest / sum(weights[i] for i in free)
        over = {i for i in free if weights[i] * level > repeats * sizes[i]}
        if not over:
            for i in free:
                target[i] = weights[i] * level
            break
        for i in over:
            target[i] = float(repeats * sizes[i])
            rest -= repeats * sizes[i]
        free -= over
    return target


def mixed(docs, weights, repeats, seed, block_tokens, shard_tokens, section, least_blocks):
    """``(doc_id, size, source_size, target, taken)`` of documents ``(doc_id, text, source)``, a token at a time."""
    docs = [(d, len(words(t)), s) for d, t, s in docs]
    names = sorted({s for *_, s in docs if s is not None}) + [None] * any(s is None for *_, s in docs)
    sizes = [sum(n for _, n, s in docs if s == name) for name in names]
    targets = level_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], repeats)
    block = max(1, min(block_tokens, int(min([t for t in targets if t > 0], default=0) // least_blocks)))
    draw = lambda x: int(hashlib.md5(x.encode()).hexdigest()[:15], 16)
    key = lambda d: f"{seed}:{'' if d is None else d}"
    shards = defaultdict(lambda: defaultdict(list))
    for d, n, s in docs:
        i = names.index(s)
        shards[i][draw(key(d)) % max(1, -(-sizes[i] // shard_tokens))].append((hashlib.md5(key(d).encode()).hexdigest(), d is not None, d, n))
    blocks = {i: {h: -(-sum(n for *_, n in own) // block) for h, own in sorted(by.items())} for i, by in shards.items()}
    quota = seats_one_by_one(targets, [repeats * sum(blocks[i].values()) for i in range(len(names))],
                             (2 * sum(sizes) + block) // (2 * block))
    rows = []
    for i, by in shards.items():
        sections = sorted({h // section for h in by})
        tokens = lambda hs: sum(n for h in hs for *_, n in by[h])
        inside = {c: [h for h in sorted(by) if h // section == c] for c in sections}
        first = seats_one_by_one([tokens(inside[c]) for c in sections], [repeats * sum(blocks[i][h] for h in inside[c]) for c in sections], quota[i])
        for c, seats in zip(sections, first):
            second = seats_one_by_one([tokens([h]) for h in inside[c]], [repeats * blocks[i][h] for h in inside[c]], seats)
            for h, won in zip(inside[c], second):
                n = max(1, blocks[i][h])
                start = draw(f"{seed}:{names[i] or ''}:{h}") % n
                times = [won // n + ((b + 1) * (won % n) + start) // n - (b * (won % n) + start) // n for b in range(n)]
                place = 0
                for _, _, d, size in sorted(by[h], key=lambda x: (x[0], x[1], x[2] or 0, x[3])):
                    taken = sum(times[t // block] for t in range(place, place + size))
                    rows.append((d, size, sizes[i], targets[i], taken))
                    place += size
    return rows


TERM = re.compile("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def ranked(docs, items, k=10):
    """``(item_id, rank, doc_id, score)`` by scoring all documents that hold a term."""
    terms = [(d, Counter(TERM.findall((t or "").translate(LOWER)))) for d, t in docs]
    terms = [(d, c, sum(c.values())) for d, c in terms if c]
    total, many = sum(n for *_, n in terms), len(terms)
    df = Counter(t for _, c, _ in terms for t in c)
    asked = defaultdict(set)
    for i, text in items:
        asked[i] |= set(TERM.findall((text or "").translate(LOWER)))
    rows = []
    for i, own in asked.items():
        found = []
        for d, c, n in terms:
            m = 100 - 90 + (90 * n * many) // total
            score = sum(math.floor(1000 * math.log((2 * many + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in own if t in c)
            if score > 0:
                found.append((-score, d is not None, d, score))
        rows += [(i, r + 1, d, score) for r, (_, _, d, score) in enumerate(sorted(found, key=lambda x: (x[0], x[1], x[2] or 0))[:k])]
    return rows
