"""Licence scans: sparse TF-IDF cosine of licence headers and files to templates, then inheritance from directories.

All is DataFrame expressions.  Passages are windows of one to ``WINDOWS[-1]`` neighbouring lines anywhere in a text, as notices are wrapped over lines
(comment marks aren't tokens, so they don't matter); a file that is named like a licence is one passage as a whole too.  Inverse document frequencies of the templates' tokens come from all documents; any other token is as
rare as one that no document has.  A passage can only be as similar as asked to a template if it has one of the
template's telling tokens (without them the rest of its weight is too little), so passages without any such token are left out
before they are scored, which loses none; windows are made around the lines that have one.

A file without a licence of its own takes that of the nearest directory above it that has a licence file.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import checkpointed, text_column

#: Templates (fixed values: the usual wording of licence notices and of the short licences as a whole, by SPDX identifier).
TEMPLATES = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "MIT License. Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "GPL-2.0": [
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    ],
    "AGPL-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "LGPL-2.1": [
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA",
    ],
    "LGPL-3.0": [
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-ND-4.0": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-NC-SA-4.0": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND-4.0": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "CC0-1.0": ["Dedicated to the public domain under CC0 1.0 Universal.", "This work is marked with CC0 1.0 Universal, Creative Commons Public Domain Dedication."],
    "BSD-2-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
    "BSD-3-Clause": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    ],
}
#: What tells licences of one family apart (fixed values: a mark and the wording that it stands for), besides the number of a version.
MARKS = {
    "affero": r"affero",
    "lesser": r"lesser",
    "library": r"library[^a-z0-9]+general",
    "nc": r"non-?commercial|by-nc",
    "sa": r"share-?alike|(by|nc)-sa",
    "nd": r"no-?deriv|(by|nc)-nd",
    "names": r"neither[^a-z0-9]+the[^a-z0-9]+name",
    "advertising": r"advertising",
}
VERSION = r"(?:version|licen[cs]e|mpl|cc0|by|nc|sa|nd|attribution|noncommercial|sharealike|noderivatives)[\s,/*#;-]{1,6}(?:v\.? ?)?([0-9]+(?:\.[0-9]+)?)"
#: How much less similar any other licence with the same marks must be.
MARGIN = 0.02
#: What a passage is called that is like a licence but has other marks, or is as much like another one.
UNSURE = "unsure"
#: Cosine from which a passage is a licence.
SIMILAR = 0.8
#: Lines of a passage.
WINDOWS = (1, 2, 3, 5, 8, 13, 21)
#: Names of licence files, in lower case.
FILE_NAMES = r"^(license|licence|copying|unlicense)([._-].*)?$"


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits of ASCII; a point between digits stays, as in version numbers."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+|[0-9]+(?:\.[0-9]+)*"), F.lit(0))


def _plain_tokens(text: str) -> list[str]:
    return re.findall(r"[a-z]+|[0-9]+(?:\.[0-9]+)*", text.lower())


def marks(text: Column) -> Column:
    """The marks of a text and the numbers of its versions, in order and joined."""
    t = F.lower(text)
    words = [F.when(t.rlike(pattern), F.lit(mark)) for mark, pattern in MARKS.items()]
    versions = F.transform(F.regexp_extract_all(t, F.lit(VERSION), F.lit(1)), lambda v: F.regexp_replace(v, r"\.0$", ""))
    return F.array_join(F.concat(F.array_compact(F.array(*words)), F.array_sort(F.array_distinct(versions))), " ")


def _told(text: Column) -> Column:
    """How many of :data:`MARKS` a text has."""
    t = F.lower(text)
    return sum((t.rlike(pattern).cast("int") for pattern in MARKS.values()), F.lit(0))


def plain_marks(text: str) -> str:
    t = text.lower()
    return " ".join([mark for mark, pattern in MARKS.items() if re.search(pattern, t)] + sorted({re.sub(r"\.0$", "", v) for v in re.findall(VERSION, t)}))


def document_frequencies(files: DataFrame, templates: dict[str, list[str]], text_col: str = "text") -> tuple[int, dict[str, int]]:
    """Number of files, and of those that have each token of the templates: as many numbers as the templates have tokens."""
    vocabulary = sorted({t for texts in templates.values() for x in texts for t in _plain_tokens(x)})
    known = F.array(*map(F.lit, vocabulary))
    has = files.select(F.explode(F.array_append(F.array_intersect(tokens(text_column(text_col)), known), F.lit(""))).alias("token"))
    counts = {x["token"]: x["count"] for x in has.groupBy("token").count().collect()}
    return counts.pop("", 0), counts


def _weights(n: int, df: dict[str, int], templates: dict[str, list[str]]) -> tuple[list[tuple[str, int, dict[str, float]]], dict[str, float], float]:
    """Unit vectors of the templates, idf of their tokens, idf of all other tokens."""
    idf = lambda t: math.log((1 + n) / (1 + df.get(t, 0))) + 1
    out, seen = [], {}
    for name, texts in templates.items():
        for k, text in enumerate(texts):
            tf: dict[str, float] = {}
            for t in _plain_tokens(text):
                tf[t] = tf.get(t, 0.0) + 1
                seen[t] = idf(t)
            raw = {t: c * seen[t] for t, c in tf.items()}
            size = math.sqrt(sum(w * w for w in raw.values()))
            out.append((name, k, {t: w / size for t, w in raw.items()}))
    return out, seen, math.log(1 + n) + 1


def telling_tokens(vector: dict[str, float], similar: float, df: dict[str, int]) -> list[str]:
    """Tokens without all of which the cosine must stay below ``similar``: those in few documents for their weight, so that few passages have one."""
    left, out = 1.0, []
    for token, weight in sorted(vector.items(), key=lambda x: (df.get(x[0], 0) / (x[1] * x[1]), -x[1], x[0])):
        if math.sqrt(max(left, 0)) < similar:
            break
        out.append(token)
        left -= weight * weight
    return out


def _windows(lines: Column, sure: str) -> Column:
    """First line and size of every window with a line that has a telling token."""
    n = F.size(lines)
    told = F.filter(F.sequence(F.lit(0), n - 1), lambda k: F.get(lines, k).rlike(sure))
    none = F.array().cast("array<struct<line:int,size:int>>")

    def around(k: Column, w: int) -> Column:
        starts = F.sequence(F.greatest(k - (w - 1), F.lit(0)), F.least(k, n - w))
        return F.when(n >= w, F.transform(starts, lambda at: F.struct(at.alias("line"), F.lit(w).alias("size")))).otherwise(none)

    return F.array_distinct(F.flatten(F.transform(told, lambda k: F.concat(*[around(k, w) for w in WINDOWS]))))


def _able(passage: Column, idf: dict[str, float], other: float, similar: float) -> Column:
    """Whether a passage can be ``similar`` to a template: what no template has weighs too much otherwise.

    The cosine is at most the share of the templates' tokens in the passage's length; each other token adds at least its weight once.
    """
    known, weights = F.array(*map(F.lit, idf)), F.create_map(*[F.lit(x) for item in idf.items() for x in item])

    def holds(ts: Column) -> Column:
        square = lambda t: F.pow((F.size(ts) - F.size(F.array_remove(ts, t))) * F.try_element_at(weights, t), F.lit(2.0))
        inside = F.aggregate(F.array_intersect(ts, known), F.lit(0.0), lambda sum_, t: sum_ + square(t))
        return F.size(F.array_except(ts, known)) * (other * other) <= inside * ((1 / (similar * similar) - 1) * (1 + 1e-6)) + 1e-6

    return F.get(F.transform(F.array(tokens(passage)), holds), F.lit(0))


def matches(files: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, similar: float = SIMILAR, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``path, license, similarity, line, size, passage, is_file, sure, told``: the best licence of each passage that is similar enough to a template.

    A licence is named only if its template has the passage's marks (:data:`MARKS`, of which it has ``told``, and versions) and any other licence of which that holds is less similar by more than
    :data:`MARGIN`; other passages are ``unsure``, so a licence without a template isn't taken for its next of kin.

    Similarities are rounded to nine places, so that summation order makes no difference; ties go to the first template.  ``line`` counts from 0, -1 is a whole licence file, and
    ``size`` is the number of lines.  Null texts are empty and have no passages; a null path is a file that is in no directory; rows that repeat a path each count.
    """
    n, df = document_frequencies(files, templates, text_col)
    vectors, idf, other = _weights(n, df, templates)
    telling = sorted({t for _, _, v in vectors for t in telling_tokens(v, similar, df)})
    text = text_column(text_col)
    named = F.coalesce(F.lower(F.element_at(F.split(F.col(path_col), "/"), -1)).rlike(FILE_NAMES), F.lit(False))
    lines = F.split(text, "\n", -1)
    sure = r"(?i)(?<![a-z])(?:" + "|".join(t.replace(".", r"\.") for t in telling) + r")(?![a-z])"
    some = files.where(text.rlike(sure)).select(F.col(path_col).alias("path"), named.alias("is_file"), lines.alias("lines"))
    passages = some.select("path", "is_file", "lines", F.explode(_windows(F.col("lines"), sure)).alias("w")).select("path", "is_file", "w.line", "w.size", F.array_join(F.slice("lines", F.col("w.line") + 1, F.col("w.size")), "\n").alias("passage"))
    whole = some.where("is_file").select("path", "is_file", F.lit(-1).alias("line"), F.size("lines").alias("size"), F.array_join("lines", "\n").alias("passage"))
    held = checkpointed(passages.unionByName(whole).where(_able(F.col("passage"), idf, other, similar)).withColumn("n", F.monotonically_increasing_id()))
    # the templates' few weights are broadcast, a row for each token (and template)
    spark = files.sparkSession
    known = F.broadcast(spark.createDataFrame([(t, x) for t, x in idf.items()], "token string, idf double"))
    models = F.broadcast(spark.createDataFrame([(t, k, name, w) for k, (name, _, v) in enumerate(vectors) for t, w in v.items()], "token string, rank int, license string, weight double"))
    terms = held.select("n", F.explode(tokens(F.col("passage"))).alias("token")).groupBy("n", "token").agg(F.count("*").alias("tf"))
    weighed = terms.join(known, "token", "left").select("n", "token", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("w"))
    size = weighed.groupBy("n").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    dots = weighed.join(models, "token").groupBy("n", "rank", "license").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    scored = dots.join(size, "n").withColumn("similarity", F.round(F.col("dot") / F.col("size"), 9)).where(F.col("similarity") >= similar)
    marked = F.broadcast(spark.createDataFrame([(k, plain_marks(templates[name][place])) for k, (name, place, _) in enumerate(vectors)], "rank int, marks string"))
    agreed = scored.join(marked, "rank").join(held.select("n", marks(F.col("passage")).alias("own")), "n").withColumn("agrees", F.col("marks") == F.col("own"))
    by_licence = agreed.groupBy("n", "license").agg(F.max(F.struct("agrees", "similarity", (-F.col("rank")).alias("r"))).alias("x"))
    # at most as many licences as there are templates
    listed = by_licence.groupBy("n").agg(F.reverse(F.array_sort(F.collect_list(F.struct("x.agrees", "x.similarity", "x.r", "license")))).alias("of"))
    first, second = F.get("of", F.lit(0)), F.get("of", F.lit(1))
    sure = first["agrees"] & ~F.coalesce(second["agrees"] & (second["similarity"] > F.round(first["similarity"] - MARGIN, 9)), F.lit(False))
    likest = F.aggregate("of", F.lit(0.0), lambda most, x: F.greatest(most, x["similarity"]))
    best = listed.select("n", sure.alias("sure"), F.when(sure, first["license"]).otherwise(UNSURE).alias("license"), F.when(sure, first["similarity"]).otherwise(likest).alias("similarity"))
    return held.join(best, "n").select("path", "license", "similarity", "line", "size", "passage", "is_file", "sure", _told(F.col("passage")).alias("told"))


def parents(path: Column) -> Column:
    """All directories above a path with their depth, the root (an empty name) too."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("directory")))


def scan(files: DataFrame, *, templates: dict[str, list[str]] = TEMPLATES, similar: float = SIMILAR, path_col: str = "path", text_col: str = "text") -> DataFrame:
    """``path, license, similarity, origin, origin_path`` of every file (row).

    ``origin`` is ``header`` or ``file`` (its own text: of the passages with most marks, without versions, one that is sure, then the most similar; ties to the first line and then the fewest lines; ``unsure`` if none of these is sure), ``inherited`` (the licence file of the nearest directory above, ties to the
    smallest path) or ``none``.  A null path inherits nothing.
    """
    found = checkpointed(matches(files, templates=templates, similar=similar, path_col=path_col, text_col=text_col))
    order = F.struct("told", "sure", F.col("similarity"), (-F.col("line")).alias("l"), (-F.col("size")).alias("s"), F.col("license"))
    own = found.groupBy("path").agg(F.max_by(F.struct("license", "similarity", "is_file"), order).alias("own"))
    parts = F.split("path", "/")
    given = own.where("own.is_file and path is not null").withColumn("directory", F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/"))
    given = checkpointed(given.groupBy("directory").agg(F.min_by(F.struct("own.license", "own.similarity", "path"), "path").alias("given")))
    rows = files.select(F.col(path_col).alias("path"))
    named = rows.where("path is not null").distinct()
    above = named.select("path", F.explode(parents(F.col("path"))).alias("d")).select("path", "d.depth", "d.directory")
    nearest = above.join(given, "directory").groupBy("path").agg(F.max_by("given", "depth").alias("given"))
    told = rows.join(own.withColumnRenamed("path", "p"), F.col("path").eqNullSafe(F.col("p")), "left").drop("p").join(nearest, "path", "left")
    has, takes = F.col("own").isNotNull(), F.col("given").isNotNull()
    return told.select(
        "path",
        F.coalesce("own.license", "given.license").alias("license"),
        F.coalesce("own.similarity", "given.similarity").alias("similarity"),
        F.when(has & F.col("own.is_file"), "file").when(has, "header").when(takes, "inherited").otherwise("none").alias("origin"),
        F.when(has, F.col("path")).when(takes, F.col("given.path")).alias("origin_path"),
    )
