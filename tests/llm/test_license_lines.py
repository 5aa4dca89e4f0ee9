from statloom.llm import license_scan

from . import texts as X


def test_padded_lines_are_notices(spark):
    known = license_scan.known_licenses(spark)
    rows = [(1, "-" * 9000 + " Licensed under the MIT License. " + "=" * 9000), (2, "x\n" + " " * 20_000 + "Licensed under CC BY 4.0.\ny"), (3, "word " * 5000)]
    got = {r["doc_id"]: (r["license"], r["n_notices"], r["notices"]) for r in license_scan.scan(X.frame(spark, rows), known).collect()}
    assert got == {1: ("MIT", 1, "MIT"), 2: (None, 1, "CC-BY-4.0"), 3: (None, 0, None)}


def test_published_files_of_known_licences(spark):
    import textwrap

    titles = {"MIT": "The MIT License (MIT)", "ISC": "ISC License", "0BSD": "BSD Zero Clause License", "BSD-2-Clause": "BSD 2-Clause License", "BSD-3-Clause": 'BSD 3-Clause "New" or "Revised" License', "Zlib": "zlib License", "Unlicense": "The Unlicense License"}
    full = [(n, t) for n, t in license_scan.KNOWN if len(t) > 400]
    assert {n for n, _ in full} == set(titles)
    rows, want = [], {}
    for name, text in full:
        for width in (40, 60, 72, 78, 10_000):
            for start in ("", "Copyright (c) 2021, A. Person\nAll rights reserved.\n\n", "Copyright © 1999-2004 by X\nCopyright 2005 Y Corp.\n\n"):
                for mark in ("", " * "):
                    body = "\n\n".join("\n".join(textwrap.wrap(p, width, break_on_hyphens=False)) for p in text.split("\n"))
                    whole = f"{titles[name]}\n\n{start}{body}\n"
                    want[len(rows)] = name
                    rows.append((len(rows), "\n".join(mark + line for line in whole.split("\n"))))
    cut = full[0][1].replace("copies of the Software", "parts of the Software", 1)
    rows += [(len(rows), cut), (len(rows) + 1, full[0][1] + "\n(c) the work may not be sold")]
    got = {r["doc_id"]: r["license"] for r in license_scan.scan(X.frame(spark, rows), license_scan.known_licenses(spark)).collect()}
    assert [k for k, n in want.items() if got[k] != n] == []
    assert got[len(rows) - 2] is None and got[len(rows) - 1] is None  # other words; a list item isn't a copyright statement


def test_prompts_by_place(spark):
    from statloom.llm import chat_format

    rows = [(0, t, r, x) for t, (r, x) in enumerate([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "b")])]
    rows += [(1, 10 + 5 * t, r, x) for t, (r, x) in enumerate([("user", "q"), ("assistant", "a"), ("user", "r"), ("assistant", "c")])]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (one,) = chat_format.records(chat_format.segments(turns, chat_format.neighbour_pairs(turns))).collect()
    assert one["prompt"].count("<|end|>") == 3 and (one["chosen"], one["rejected"]) == ("<|assistant|>\nb<|end|>\n", "<|assistant|>\nc<|end|>\n")
