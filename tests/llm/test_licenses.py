import re

import pytest

from gristmill.llm import licenses as op

MIT = (
    "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software "
    "and associated documentation files (the \"Software\"), to deal in it.\nThe above copyright notice and this "
    "permission notice shall be included in all copies or substantial portions of the Software.\n"
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED."
)


@pytest.mark.parametrize(
    ("text", "names"),
    [
        ("Licensed under the Apache License, Version 2.0.", ["Apache-2.0"]),
        ("Foo bar.\nReleased under the MIT License.\nMore", ["MIT"]),
        ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
        ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
        ("# SPDX-License-Identifier: BSD-3-Clause", ["BSD-3-CLAUSE"]),
        ("Copyright 2020 X. All rights reserved.", ["All-Rights-Reserved"]),
        (MIT, ["MIT"]),
        (MIT + "\n" + MIT, ["MIT", "MIT"]),
        ("Released under the MIT Licence. Licensed under CC BY 4.0.", ["MIT", "CC-BY-4.0"]),
        ("My fishing license is new. We reserve all rights to complain.", []),
        ("", []),
    ],
)
def test_rules(text, names):
    assert [n for n, _, _ in op.matches(op.recognised(text)[1])] == names


def test_a_full_text_is_one_span():
    (name, i, j), = op.matches(op.recognised("é " + MIT)[1])
    assert name == "MIT" and ("é " + MIT)[i:j].startswith("Permission") and j == len(MIT) + 2


def test_parted_sentences_do_not_make_a_rule():
    far = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files.\n"
    keep = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    near, apart = (op.recognised(far + "x.\n" * n + keep)[1] for n in (3, 4))
    assert [e - s for _, s, e in op.matches(near)] == [len(far) + 9 + len(keep)]
    assert len(list(op.matches(apart))) == 1 and next(iter(op.matches(apart)))[2] < len(far)


WRAPPED = {
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer.
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
  * Redistributions of source code must retain the above copyright
    notice, this list of conditions and the following disclaimer.
  * Redistributions in binary form must reproduce the above copyright
    notice, this list of conditions and the following disclaimer.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice appears in all copies.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain
a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2
of the License, or (at your option) any later version.""",
}

@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", "dnl "])
@pytest.mark.parametrize("name", WRAPPED)
def test_wrapped_texts(name, prefix):
    text = "\n".join((prefix + line).rstrip() for line in WRAPPED[name].split("\n"))
    (got, i, j), = op.matches(op.recognised("é x.\n" + text + "\n\ncode = 1")[1])
    whole = "é x.\n" + text
    assert got == name and whole[:i].rstrip().endswith(("é x.", "free software;")) and text.endswith(whole[i:j][-12:])


def test_lines_without_a_full_stop_stand_for_themselves():
    text = "Copyright 2020 X\nAll rights reserved\nReleased under the\nMIT License\nSPDX-License-Identifier: ISC\nint x"
    assert [(n, text[i:j]) for n, i, j in op.matches(op.recognised(text)[1])] == [
        ("All-Rights-Reserved", "All rights reserved"), ("MIT", "Released under the\nMIT License"),
        ("ISC", "SPDX-License-Identifier: ISC"),
    ]
    title = "MIT License\n" + WRAPPED["MIT"]
    assert [title[i:j] for _, i, j in op.matches(op.recognised(title)[1])] == [title]


def test_long_unended_texts_take_linear_time():
    for line in ("Copyright 2020 X", "neither the name of", "x", " " * 40, "this program is free software", "*"):
        op.recognised("licence " + f"{line}\n" * 20_000)


def brute_force(text):
    """Known single lines, looked up as they stand in the given documents."""
    lines = {
        "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
        "Released under the MIT License.": "MIT",
        "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
        "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
        "All rights reserved.": "All-Rights-Reserved",
    }
    found = [(m.start(), f"{n}:{m.start()}:{m.end()}") for s, n in lines.items()
             for m in re.finditer(rf"(?m)^{re.escape(s)}$", text or "")]
    return ",".join(s for _, s in sorted(found))


def test_whole_table(documents, corpus):
    got = {r["doc_id"]: r["spans"] for r in op.license_report(documents).collect()}
    assert got == {d: brute_force(t) for d, t in corpus.items()}


def test_odd_rows(nasty, nothing, repeated, texts):
    assert op.license_report(nasty).count() == len(texts)
    assert op.license_report(nothing).collect() == []
    assert {r["n_licenses"] for r in op.license_report(repeated).collect()} == {0}
