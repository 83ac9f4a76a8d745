"""Dockerfiles: AI base images, copied weights, libraries installed with pip."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dims as D
from ...functions import text as X
from . import finding as R

BASE_IMAGE, WEIGHT_COPY, PIP_INSTALL = 0, 1, 2
IMAGE_FIELD = rf"^[^{X.WS_CLASS}]+[{X.WS_CLASS}]+([^{X.WS_CLASS}]+)"


def dockerfile(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    libraries = D.struct_array(
        [(n, r, d) for n, (r, d) in sorted(dims.libraries.items())], ("name", "risk", "desc")
    )
    extensions = D.string_array(dims.copied_weight_extensions)

    numbered = R.numbered_lines(
        X.lines_of(content), lambda line, n: F.struct(n.alias("n"), line.alias("line"))
    )
    instructions = F.transform(
        F.filter(numbered, lambda e: e["line"].rlike(rf"(?i)^[{X.WS_CLASS}]*+(?:from|copy|add|run) ")),
        lambda e: F.struct(
            e["n"].alias("n"), X.trim(e["line"]).alias("line"), F.lower(X.trim(e["line"])).alias("low")
        ),
    )

    def base_image(e):
        image = F.regexp_extract(e["line"], IMAGE_FIELD, 1)
        hit = X.first_match(F.lower(image), dims.base_images, "key", "desc")
        return F.when(e["low"].startswith("from ") & hit.isNotNull(), R.finding(
            R.DOCKERFILE, image, "docker-image", "Container Image (Dockerfile)", "High",
            F.concat(hit["desc"], F.lit(" detected as base image")),
            R.at_line(path, e["n"]), line_no=e["n"], seq=BASE_IMAGE,
        ))

    def weight_copy(e):
        ext = F.get(F.filter(extensions, lambda x: F.contains(e["low"], x)), F.lit(0))
        is_copy = e["low"].startswith("copy ") | e["low"].startswith("add ")
        return F.when(is_copy & ext.isNotNull(), R.finding(
            R.DOCKERFILE, "Containerized Model Weight", "docker-layer", "Container Image (Dockerfile)", "High",
            F.concat(F.lit("Model weight file ("), ext, F.lit(") being copied into container image")),
            R.at_line(path, e["n"]), line_no=e["n"], seq=WEIGHT_COPY,
        ))

    def pip_installs(e):
        hits = F.filter(libraries, lambda lib: F.contains(e["low"], lib["name"]))
        return F.when(
            e["low"].startswith("run ") & e["low"].contains("pip install"),
            F.transform(hits, lambda lib, i: R.finding(
                R.DOCKERFILE, lib["name"], "docker-install", "Container Image (pip in Dockerfile)", lib["risk"],
                F.concat(lib["desc"], F.lit(" (installed in Dockerfile)")),
                R.at_line(path, e["n"]), line_no=e["n"], seq=i + PIP_INSTALL,
            )),
        ).otherwise(R.no_findings())

    return F.flatten(F.transform(
        instructions,
        lambda e: F.concat(R.present(F.array(base_image(e), weight_copy(e))), pip_installs(e)),
    ))
