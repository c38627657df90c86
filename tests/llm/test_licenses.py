"""License scans of texts in every form a license comes in."""

from quire.llm import licenses

FOUND = {
    "SPDX-License-Identifier: MIT": "MIT",
    "// SPDX-License-Identifier: Apache-2.0": "Apache-2.0",
    "SPDX-License-Identifier: GPL-3.0-or-later": "GPL-3.0",
    "SPDX-License-Identifier: BSD-2-Clause": "BSD-2-Clause",
    "SPDX-License-Identifier: AGPL-3.0-only": "AGPL-3.0",
    "Apache License": "Apache-2.0",
    "Mozilla Public License Version 2.0": "MPL-2.0",
    "GNU GENERAL PUBLIC LICENSE": "GPL",
    "GNU GENERAL PUBLIC LICENSE\n  Version 3, 29 June 2007\n\nEveryone may copy it": "GPL-3.0",
    "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007": "LGPL-3.0",
    "# Licensed under the Apache\n# License, Version 2.0 (the thing)": "Apache-2.0",
    "We met in the morning and talked. " * 9 + "All of this was released under the MIT License, as said. " + "Then we went home. " * 9: "MIT",
    "it under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 2 of the License, or later": "GPL-2.0",
    "Copyright (c) 2020 A. Person\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal": "MIT",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:": "BSD-2-Clause",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 3. Neither the name of the\ncopyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.": "BSD-3-Clause",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0",
    "Creative Commons Attribution-ShareAlike 4.0 International": "CC-BY-SA-4.0",
    "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Released under the MIT Licence": "MIT",
}
NONE = ["Eclipse Public License - v 2.0", "SPDX-License-Identifier: Zlib", "a driver's license is needed", "Fahrt mit der Lizenz, license", "Copyright 2020 by nobody", "", None]


def test_forms(spark):
    files = [(f"d{i}/x", t, False) for i, t in enumerate([*FOUND, *NONE])]
    table = spark.createDataFrame([*files, (None, "Apache License", True)], "path string, text string, is_license_file boolean")
    got = {r.path: r.license for r in licenses.scan_license_texts(table, licenses.form_table(spark)).collect()}
    assert got == {p: FOUND.get(t) for p, t, _ in files} | {None: None}


BODY = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction. " + "The above notice shall be included in all copies. " * 20


def test_inheritance_over_levels(spark):
    """A license file of any length gives its license two levels down; the nearest one counts."""
    files = [
        ("top/LICENSE", "MIT License\n\nCopyright (c) 2020 A. Person\n\n" + BODY),
        ("top/a/b/x", "plain text"),
        ("top/a/y", None),
        ("top/c/LICENSE", "Apache License\nVersion 2.0, January 2004\n" + "Terms and conditions for use and distribution. " * 400),
        ("top/c/d/e/z", "plain text"),
        ("other/long", "plain words of an essay go on and on. " * 100 + "Released under the MIT License."),
        ("other/header", "# Licensed under the Apache License, Version 2.0\n" + "x = y + 1\n" * 100),
        ("other/q/r", "plain text"),
    ]
    got = {r.path: (r.license, r.origin, r.source_path) for r in licenses.scan_license_texts(spark.createDataFrame(files, "path string, text string"), licenses.form_table(spark)).collect()}
    assert got["top/a/b/x"] == got["top/a/y"] == ("MIT", "inherited", "top/LICENSE")
    assert got["top/c/d/e/z"] == ("Apache-2.0", "inherited", "top/c/LICENSE")
    assert got["other/header"] == ("Apache-2.0", "header", "other/header")
    assert got["other/long"] == ("MIT", "header", "other/long") and got["other/q/r"] == (None, "none", None)


def test_query_has_levels(spark, tmp_path):
    """A document two levels below a license file inherits it."""
    rows = [(3, "MIT License\n" + BODY, "s"), (5, "plain text", "s"), (4, "plain text", "s"), (8, "plain text", "t")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.path, r.license, r.source_path) for r in licenses.op2_licenses_all_forms(spark, str(tmp_path)).collect()}
    assert got == {3: ("s/3", "MIT", "s/3"), 5: ("s/0/0/5", "MIT", "s/3"), 4: ("s/0/4", "MIT", "s/3"), 8: ("t/0/0/8", None, None)}
