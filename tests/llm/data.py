"""Small tables with every awkward kind of row."""

from __future__ import annotations

import random

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, score double, spans string, start bigint, bucket int, component_id bigint"


def rows() -> list[tuple]:
    rng = random.Random(7)
    syllables = ["an", "ber", "co", "den", "el", "fi", "gor", "hu", "ist", "jo", "ka", "lim"]
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 3)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, base = prose(60), prose(120)
    near = base.split()
    texts = [prose(n) for n in (1, 2, 4, 5, 6, 40, 90)]
    texts += [base, base.replace(near[50], "changed", 1), base + " and more", base.upper(), f"{prose(40)} {shared} {prose(30)}", f"{prose(20)} {shared}", shared]
    texts += [None, "", " \n\t ", "123 456", "é" * 150, "ab" * 500, "x" * 700, "x" * 700, "naïve café — “quoted” 😀 " * 30, "a<|endoftext|>b it's", prose(30_000)]
    texts += ['password = "hunter2hunter2" and secret: abc', "token=short", "AKIA" + "A1" * 8, "deadbeef" * 8, "API_KEY=" + "0123456789abcdef" * 4, "say " + "Secret:'zzzzzzzz9'" * 3]
    texts += ["-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----", "Intro. Released under the MIT License. " + prose(20), prose(9) + " Licensed under the Apache License, Version 2.0."]
    out = [(k, t, ("en", "de", None)[k % 3], f"src{k % 2}", None if t is None else len(t), 0.5, "x", 3, 1, 9) for k, t in enumerate(texts)]
    out.append(out[7])  # a whole row again
    out.append((None, base, "en", None, None, None, None, None, None, None))
    out.append((None, None, None, None, None, None, None, None, None, None))
    out.append((3, "another text under an id that is taken", "de", "src0", 38, 0.1, "y", 4, 2, 8))
    return out


def messy(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts() -> list[tuple[int | None, str]]:
    return [(r[0], r[1] or "") for r in rows()]
