"""Plain-Python versions of the contracts, for tests only."""

import hashlib
import re

WS = re.compile(r"[^\x20\x09-\x0D]+")


def secret_base(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 12:
            out.append((m.start(), 0, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 18:
            out.append((m.start(), 1, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 16:
            out.append((m.start(), 2, "hex", m.end()))
    out.sort()
    count = lambda k: sum(x[2] == k for x in out)
    return count("assign"), count("access"), count("hex"), hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, k, e in out).encode()).hexdigest()


def luhn(digits):
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii_base(text):
    text = text or ""
    email = [(m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    ip = [(m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    card = []
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        if 13 <= len(d) <= 19 and luhn(d):
            card.append((m.start(), m.end()))
    phone = [(m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    flat = ",".join(f"{k}:{s}:{e}" for k, xs in (("email", email), ("ip", ip), ("card", card), ("phone", phone)) for s, e in xs)
    return len(email), len(ip), len(card), len(phone), hashlib.sha256(flat.encode()).hexdigest()
