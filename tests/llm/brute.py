"""Plain Python versions of the operators' contracts, for small tables."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def near(rows, percent=85):
    """[(id, text)] -> {id: (n_shingles, component_id, kept)}."""
    sets = {d: shingle_set(t) for d, t in rows}
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    classes = defaultdict(list)
    for d, s in sets.items():
        if s:
            classes[s].append(d)
    reps, holders = [], defaultdict(list)
    for s, ds in classes.items():
        for d in ds[1:]:
            a, b = root(ds[0]), root(d)
            up[max(a, b)] = min(a, b)
        for x in s:
            holders[x].append(len(reps))
        reps.append((ds[0], s))
    for i, (d, s) in enumerate(reps):
        common = Counter(j for x in s for j in holders[x] if j > i)
        for j, n in common.items():
            if 100 * n >= percent * (len(s) + len(reps[j][1]) - n):
                a, b = root(d), root(reps[j][0])
                up[max(a, b)] = min(a, b)
    return {d: (len(s), root(d), root(d) == d) for d, s in sets.items()}


def _cover(spans, n):
    gone = bytearray(n)
    for a, e in spans:
        gone[a:e] = b"\1" * (e - a)
    return gone


def byte_repeats(rows, size=100):
    """[(id, text)] -> {id: (n_bytes, n_removed, n_spans, kept_sha256)}."""
    seen, out = set(), {}
    for d, t in sorted(rows):
        raw = (t or "").encode()
        spans = []
        for i in range(len(raw) - size + 1):
            w = raw[i : i + size]
            if w in seen:
                spans.append((i, i + size))
            seen.add(w)
        gone = _cover(spans, len(raw))
        kept = bytes(c for c, g in zip(raw, gone, strict=True) if not g)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = (len(raw), sum(gone), runs, sha(kept))
    return out


def word_repeats(rows, size=35):
    """[(id, text)] -> {id: (n_words, n_removed, kept_sha256)}."""
    words = {d: WORD.findall(t or "") for d, t in rows}
    count = Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    out = {}
    for d, w in words.items():
        gone = _cover([(i, i + size) for i in range(len(w) - size + 1) if count[tuple(w[i : i + size])] > 1], len(w))
        kept = [x for x, g in zip(w, gone, strict=True) if not g]
        out[d] = (len(w), sum(gone), sha(" ".join(kept)))
    return out


def exact(rows):
    """[(id, text)] -> {id: (keep_id, group_size, kept, text_sha256)}; ids are distinct."""
    groups = defaultdict(list)
    for d, t in rows:
        groups[t or ""].append(d)
    return {d: (max(g), len(g), d == max(g), sha(t)) for t, g in groups.items() for d in g}


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


def personal(text):
    """Base matches of the whole patterns over the whole text: [(start, kind, end)]."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text if "@" in text else "")]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def leaks(rows, items, size=13):
    """-> {id: (n_words, n_hit, n_items, items_sha256, contaminated)}."""
    windows = defaultdict(set)
    for i, t in items:
        w = ALNUM.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[k : k + n])].add(str(i))
    sizes = {len(w) for w in windows}
    out = {}
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        out[d] = (len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w))
    return out


def mix_targets(sizes, weights=(5, 2, 1), most=3):
    """{source: size} -> {source: target} by filling round after round."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = {}, sum(sizes.values()), set(order)
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: float(most * sizes[s]) for s in over}
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


def url_parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(LOWER), re.match(r"[^?#]*", rest[len(host) :])[0]


def url_rule(host, path):
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fit)[1:] if fit else (None, None)


def url_tree(pages, rules, u):
    """[(host, path, label or None)] -> [(template, purity, told)]; u: the url filter's module, for its constants."""
    def shape(path):
        return tuple("*" + (re.search(r"(\.[A-Za-z]{1,5})$", s) or [""])[0] if re.search("[0-9]", s) else s for s in path.removeprefix("/").split("/"))

    shapes = [shape(p) for _, p, _ in pages]
    name, same = [""] * len(pages), [""] * len(pages)
    for d in range(max(map(len, shapes), default=0)):
        kids, nodes = defaultdict(lambda: [0, 0, 0]), defaultdict(list)
        for i, (host, _, label) in enumerate(pages):
            if d < len(shapes[i]):
                k = kids[host, name[i], shapes[i][d]]
                for j, v in enumerate((1, label == "block", label is not None)):
                    k[j] += v
        for (host, t, part), k in kids.items():
            nodes[host, t].append(k)
        before, plain_before = list(name), list(same)
        for i, (host, _, _) in enumerate(pages):
            if d >= len(shapes[i]):
                continue
            part, all_kids = shapes[i][d], nodes[host, before[i]]
            cn, cb, cl = kids[host, before[i], part]
            pn, pb, pl = (sum(k[j] for k in all_kids) for j in range(3))
            share = (pb + 0.5) / (pl + 1)
            z = abs(cb / max(cl, 1) - share) * (cl / (share * (1 - share))) ** 0.5
            plain = "*" if pn >= u.LEAST and len(all_kids) > u.VARIED * pn and cn < u.LEAST and cl < u.SURE else part
            alike = cl >= u.SURE and sum(k[2] >= u.SURE for k in all_kids) > 1 and z < u.Z
            name[i], same[i] = f"{before[i]}/{u.SIMILAR if alike else plain}", f"{plain_before[i]}/{plain}"

    def tally(keys):
        out = defaultdict(lambda: [0, 0])
        for k, (_, _, label) in zip(keys, pages, strict=True):
            if k is not None:
                out[k][0] += label == "block"
                out[k][1] += label is not None
        return out

    hosts = [h for h, _, _ in pages]
    own, by_host, by_same = tally(list(zip(hosts, name, strict=True))), tally(hosts), tally(same)
    of = defaultdict(set)
    for h, t, s in zip(hosts, name, same, strict=True):
        if re.search("/[^*/]", s):
            of[h, t].add(s)
    b, n = (sum(v[j] for v in by_host.values()) for j in (0, 1))
    smooth = lambda x, prior: (x[0] + u.STRENGTH * prior) / (x[1] + u.STRENGTH)
    out = []
    for h, t in zip(hosts, name, strict=True):
        others = [sum(by_same[s][j] for s in of[h, t]) for j in (0, 1)]
        purity = smooth(own[h, t], smooth(others, smooth(by_host[h], b / n if n else 0.0)))
        out.append((t, purity, "block" if max(own[h, t][1], others[1]) >= u.SURE and purity >= u.REJECT else "allow"))
    return out
