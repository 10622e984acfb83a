"""Licences as they stand in real files: standard headers, short forms, and prose about licences."""

from foliant.llm import licences

HEADERS = {
    "gpl-3.0": ["This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU General Public License for more details.", "This file is licensed under the GPLv3 or later.", "# SPDX-License-Identifier: GPL-3.0-only"],
    "gpl-2.0": ["# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", "SPDX-License-Identifier: GPL-2.0-or-later"],
    "lgpl": ["This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.", "The library is distributed under the GNU Lesser General Public License, version 3."],
    "agpl-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache-2.0": ['Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software\ndistributed under the License is distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.', "License: Apache-2.0"],
    "bsd": ["Copyright (c) 2020 Jane Doe. All rights reserved.\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "mit": ["License: MIT", "MIT License\n\nCopyright (c) 2021 Jane Doe\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal\nin the Software without restriction, including without limitation the rights\nto use, copy, modify, merge, publish, distribute, sublicense, and/or sell\ncopies of the Software."],
}
PLAIN = ["he lost his driving licence after the accident", "Our copyright debate in parliament went on", "Copyright (c) 2020 Jane Doe. All rights reserved.", "The shop asked for permission to sell wine until midnight.", "Her fishing licence is valid for one more year, said the warden.", "The licence fee pays for the public broadcaster and its orchestras."]
OTHERS = ["Licensed under the Academic Free License, version 3.0", "This module is released under the Acme Shared Source License.", "SPDX-License-Identifier: EUPL-1.2"]


def scanned(spark, texts):
    return {r["doc_id"]: (r["families"], r["n_unknown"]) for r in licences.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}


def test_standard_headers_give_their_family_alone(spark):
    cases = [(f, t) for f, texts in HEADERS.items() for t in texts]
    found = scanned(spark, [t for _, t in cases] + ["Words before it.\n\n" + t + "\n\nAnd more words after it, of no licence." for _, t in cases])
    wrong = [(f, found[i + k * len(cases)], t[:60]) for k in (0, 1) for i, (f, t) in enumerate(cases) if found[i + k * len(cases)][0] != f]
    assert not wrong


def test_prose_about_licences_is_none(spark):
    assert set(scanned(spark, PLAIN).values()) == {("", 0)}


def test_other_licences_are_unknown(spark):
    assert set(scanned(spark, OTHERS).values()) == {("", 1)}


def test_the_class_decides_what_is_unknown(spark):
    """The count follows the classifier's probability, not a list of words: with a threshold above it, nothing is unknown."""
    frame = spark.createDataFrame(list(enumerate(OTHERS)), "doc_id long, text string")
    found = licences.notices(frame).collect()
    assert all(r["licence"] >= 0.5 and r["family"] in (licences.UNKNOWN, *licences.NOTICES) for r in found)
    assert licences.scan(frame, least_probability=1.0).where("n_unknown > 0").count() == 0


