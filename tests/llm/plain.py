"""Plain Python versions of the operators, for comparison."""

import datetime
import hashlib
import itertools
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t)


def plain_url(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = lower(re.match("[^/?#]*", rest).group())
        path = re.match("[^?#]*", rest[len(re.match("[^/?#]*", rest).group()) :]).group()
    fits = [(h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule = max(fits, key=lambda r: len(r[0]), default=(None, "allow"))
    return host, path, *rule


def plain_statistics(t):
    t = t or ""
    w = WORD.findall(t)
    places = {}
    for i in range(len(w) - 2):
        places.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def plain_line_fails(line, phrases):
    n = max(1, len(WORD.findall(line)))
    odd, shouts, bars = (len(re.findall(p, line)) for p in (r"[#*$%&<>{}\\^~=_]", r"[!?]{2,}", r"[|»›•]"))
    return odd > 2 and odd > n / 2 or shouts > 2 and shouts > n / 2 or bars > 1 and bars > n / 4 or n <= 15 and any(p in line.lower() for p in phrases)


def plain_quality(t, phrases):
    """(clean text, kept)."""
    n, chars, _, _, repeated = plain_statistics(t)
    clean = "\n".join(x for x in (t or "").split("\n") if not plain_line_fails(x, phrases))
    lost = 1 - sum(map(len, WORD.findall(clean))) / chars if chars else 0
    return clean, n >= 50 and 2 * repeated <= n and lost <= 0.5


def plain_components(texts, percent=90, n=3):
    sets = []
    for t in texts:
        w = WORD.findall(lower(t or ""))
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    name = list(range(len(texts)))
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((name[a], name[b]))
            name = [x if c == y else c for c in name]
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, name, strict=True))]


def plain_contamination(texts, items):
    grams = {}
    for i, t in items:
        w = ITEM.findall(lower(t or ""))
        n = min(13, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            grams.setdefault(tuple(w[k : k + n]), set()).add(i)
    sizes = {len(g) for g in grams}
    out = []
    for t in texts:
        w = ITEM.findall(lower(t or ""))
        hit, found = set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := grams.get(tuple(w[k : k + n]))) is not None:
                    hit |= set(range(k, k + n))
                    found |= g
        out.append((len(w), len(hit), len(found), ",".join(sorted(map(str, found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def plain_move(value, key, tweak):
    """The permutation of a string within its character classes, round by round."""
    a, b = value[: len(value) // 2], value[len(value) // 2 :]
    classes = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"]
    for r in range(1, 7):
        h = hashlib.sha256("\x01".join([key, tweak, str(r), b]).encode()).digest()
        new = ""
        for i, c in enumerate(a):
            of = next((x for x in classes if c in x), None)
            new += of[(of.index(c) + h[i % 32]) % len(of)] if of else c
        a, b = b, new
    return a + b


def plain_pair(a, b, na, nb, key, tweak):
    draw = lambda r, x, side: int(hashlib.sha256("\x01".join([key, tweak + side, str(r), str(x)]).encode()).hexdigest()[:14], 16)
    for r in range(1, 4):
        a = (a + draw(r, b, "a")) % na
        b = (b + draw(r, a, "b")) % nb
    return a, b


def plain_luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10


def plain_97(text):
    return int("".join(str(int(c, 36)) for c in text)) % 97


def refilled(shape, new, places="[0-9]"):
    new = iter(new)
    return re.sub(places, lambda m: next(new), shape)


MONTHS = "January February March April May June July August September October November December".split()
START = datetime.date(1600, 1, 1)


def plain_date(kind, m):
    n = re.findall("[0-9]+", m)
    try:
        y, mo, d = {"date": n, "date_ymd": n, "date_mdy": [n[-1], *n[:2]], "date_dmy": n[::-1], "date_long": [n[-1], MONTHS.index(m.split(" ")[0]) + 1 if kind == "date_long" else 0, n[0]]}[kind]
        day = (datetime.date(int(y), int(mo), int(d)) - START).days
    except ValueError:
        return None
    return day if 0 <= day < 292_000 and plain_day(kind, day) == m else None


def plain_day(kind, day):
    x = START + datetime.timedelta(day)
    return {"date": f"{x:%Y-%m-%d}", "date_ymd": f"{x:%Y/%m/%d}", "date_mdy": f"{x:%m/%d/%Y}", "date_dmy": f"{x:%d.%m.%Y}", "date_long": f"{MONTHS[x.month - 1]} {x.day}, {x.year}"}[kind]


def plain_pseudonym(kind, m, key):
    """The replacement of a found value, or None if it isn't valid."""
    d = re.sub("[^0-9]", "", m)
    if kind == "email":
        name, host = m.split("@")
        rest, dot, top = host.rpartition(".")
        return f"{plain_move(name, key, 'email')}@{plain_move(rest + dot, key, 'host')}{top}" if dot and re.search("[A-Za-z]$", top) else None
    if kind in ("aws_key", "github"):
        return m[:4] + plain_move(m[4:], key, kind)
    if kind == "jwt":
        x = m.split(".")
        return f"eyJ{plain_move(x[0][3:], key, 'jwt0')}.eyJ{plain_move(x[1][3:], key, 'jwt1')}.{plain_move(x[2], key, 'jwt2')}"
    if kind == "secret":
        value = re.search(r"([A-Za-z0-9_+/.-]{8,})$", m).group()
        return m[: len(m) - len(value)] + plain_move(value, key, "secret")
    if kind == "iban":
        x = m.replace(" ", "")
        if not 15 <= len(x) <= 34 or plain_97(x[4:] + x[:4]) != 1 or not "02" <= x[2:4] <= "98":
            return None
        account = plain_move(x[4:], key, "iban")
        return refilled(m, f"{x[:2]}{98 - plain_97(account + x[:2] + '00'):02d}{account}", "[0-9A-Z]")
    if kind == "ip":
        o = [int(x) for x in m.split(".")]
        if max(o) > 255:
            return None
        a, b = plain_pair(o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536, key, "ip")
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"
    if kind.startswith("date"):
        day = plain_date(kind, m)
        if day is None:
            return None
        a, b = plain_pair(day % 73_000 // 200, day % 73_000 % 200, 365, 200, key, "date")
        return plain_day(kind, day - day % 73_000 + a * 200 + b)
    if kind == "ssn":
        area, group, serial = (int(x) for x in m.split("-"))
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        a, b = plain_pair((area - 1 - (area > 666)) * 99 + group - 1, serial - 1, 898 * 99, 9999, key, "ssn")
        area = a // 99 + 1
        return f"{area + (area >= 666):03d}-{a % 99 + 1:02d}-{b + 1:04d}"
    if kind == "phone":
        if not 7 <= len(d) <= 15:
            return None
        head = re.match(r"(\+[0-9]{1,3}(?=[ .(-]))?", m).group()
        d = re.sub("[^0-9]", "", m[len(head) :])
        code = lambda x: (0, 200) if x < 200 else (200, 800)
        if len(d) == 10:
            (a0, na), (b0, nb) = code(int(d[:3])), code(int(d[3:6]))
            a, b = plain_pair(int(d[:3]) - a0, (int(d[3:6]) - b0) * 10_000 + int(d[6:]), na, nb * 10_000, key, "phone10")
            new = f"{a + a0:03d}{b + b0 * 10_000:07d}"
        elif len(d) == 7 and not head:
            b0, nb = code(int(d[:3]))
            a, b = plain_pair(int(d[:3]) - b0, int(d[3:]), nb, 10_000, key, "phone7")
            new = f"{a + b0:03d}{b:04d}"
        else:
            new = plain_move(d, key, "phone")
        return head + refilled(m[len(head) :], new)
    assert kind == "card"
    if plain_luhn(d):
        return None
    body = d[0] + plain_move(d[1:-1], key, "card")
    return refilled(m, body + str(-plain_luhn(body + "0") % 10))


def plain_pii(text, patterns, key):
    """(text, kinds found)."""
    if text is None:
        return None, []
    kinds = []

    def replace(m):
        for kind, pattern in patterns.items():
            # As the pattern stands alone, what is round the value no longer counts.
            if re.fullmatch(pattern, m.group()) and (new := plain_pseudonym(kind, m.group(), key)) is not None:
                kinds.append(kind)
                return new
        return m.group()

    return re.sub("|".join(f"(?:{p})" for p in patterns.values()), replace, text), kinds
