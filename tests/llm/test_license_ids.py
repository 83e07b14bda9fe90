"""Identifier rules against real SPDX lines, and abbreviations."""

import pytest

from tessera.llm.license_scan import IDS, NAMES, license_scan
from tests.llm.helpers import docs_frame

SPDX = {
    "agpl": ["AGPL-3.0-only"], "lgpl": ["LGPL-2.1-only", "LGPL-3.0+"], "gpl": ["GPL-3.0-or-later", "GPL-2.0"], "gfdl": ["GFDL-1.3-or-later"], "apache": ["Apache-2.0"], "mit": ["MIT"], "mit-0": ["MIT-0"],
    "bsd-2-clause": ["BSD-2-Clause"], "bsd-3-clause": ["BSD-3-Clause"], "bsd-4-clause": ["BSD-4-Clause"], "bsd": ["0BSD", "BSD-1-Clause"], "isc": ["ISC"], "mpl": ["MPL-2.0"], "epl": ["EPL-2.0"], "cddl": ["CDDL-1.0"],
    "cpl": ["CPL-1.0"], "ipl": ["IPL-1.0"], "eupl": ["EUPL-1.2"], "cecill": ["CECILL-2.1", "CECILL-B"], "artistic": ["Artistic-2.0"], "zlib": ["Zlib"], "libpng": ["Libpng", "libpng-2.0"], "boost": ["BSL-1.0"],
    "unlicense": ["Unlicense"], "wtfpl": ["WTFPL"], "cc0": ["CC0-1.0"], "cc-by-nc-nd": ["CC-BY-NC-ND-4.0"], "cc-by-nc-sa": ["CC-BY-NC-SA-4.0"], "cc-by-nc": ["CC-BY-NC-4.0"], "cc-by-nd": ["CC-BY-ND-4.0"],
    "cc-by-sa": ["CC-BY-SA-4.0"], "ofl": ["OFL-1.1"], "odbl": ["ODbL-1.0"], "odc-by": ["ODC-By-1.0"], "pddl": ["PDDL-1.0"], "python": ["PSF-2.0", "Python-2.0"], "php": ["PHP-3.01"], "ruby": ["Ruby"], "openssl": ["OpenSSL"],
    "postgresql": ["PostgreSQL"], "ncsa": ["NCSA"], "upl": ["UPL-1.0"], "ms-pl": ["MS-PL"], "ms-rl": ["MS-RL"], "apsl": ["APSL-2.0"], "osl": ["OSL-3.0"], "afl": ["AFL-3.0"], "bsl": ["BUSL-1.1"], "sspl": ["SSPL-1.0"],
    "elastic": ["Elastic-2.0"], "vim": ["Vim"], "w3c": ["W3C"], "x11": ["X11"],
}
SHORT = [
    ("licensed under the GPL v3", "gpl"), ("released under GPLv2 or later", "gpl"), ("see the LGPL 2.1", "lgpl"), ("under MPL 2.0.", "mpl"), ("Licensed under Apache 2.0", "apache"), ("MIT licensed", "mit"),
    ("MIT/X11 license", "mit"), ("Distributed under the terms of the MIT", "mit"), ("the GNU GPL", "gpl"), ("GNU AGPLv3", "agpl"), ("published under the\n GNU Lesser GPL", "lgpl"), ("code: Apache-2.0", "apache"), ("available under EPL-2.0", "epl"),
    ("provided under the GNU GFDL", "gfdl"), ("BSD-style license", "bsd"), ("MS-PL", "ms-pl"), ("the 3-clause BSD license", "bsd-3-clause"), ("licensed under the MIT No Attribution license", "mit-0"),
]
EXPRESSIONS = [
    ("MIT OR Apache-2.0", {"mit", "apache"}), ("(GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause) AND Zlib", {"gpl", "bsd-3-clause", "zlib"}),
    ("MIT\nthis package and ruby scripts or python", {"mit"}),
]
PLAIN = ["Er kommt mit 2 Hunden", "a simple 5 step example", "apache 2.4.1 runs", "the EPL 2023 season", "python and ruby", "they came under the mitten", "disc 2 of 3", "Apache tribes"]


def labels(spark, texts):
    found = license_scan(docs_frame(spark, list(enumerate(texts)))).collect()
    return [set(r.labels.split(",")) - {""} - set(r.base_labels.split(",")) for r in sorted(found, key=lambda r: r.doc_id)]


def test_every_identifier_rule_on_its_spdx_line(spark):
    assert set(SPDX) == set(IDS) == {label for label, _, _ in NAMES} - {"edl", "public-domain"}
    lines = [(x, label) for label, ids in SPDX.items() for x in ids]
    found = labels(spark, [f"// SPDX-License-Identifier: {x}\nint main" for x, _ in lines])
    assert [(x, f) for (x, _), f in zip(lines, found)] == [(x, {label}) for x, label in lines]


def test_identifier_expressions(spark):
    assert labels(spark, [f"# SPDX-License-Identifier: {x}" for x, _ in EXPRESSIONS]) == [wanted for _, wanted in EXPRESSIONS]


def test_abbreviations(spark):
    assert list(zip(SHORT, labels(spark, [x for x, _ in SHORT]))) == [((x, label), {label}) for x, label in SHORT]
    assert list(zip(PLAIN, labels(spark, PLAIN))) == [(x, set()) for x in PLAIN]
