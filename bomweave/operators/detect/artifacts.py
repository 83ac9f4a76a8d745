"""Model weight files and GPU cost findings (Kubernetes, Helm, Terraform)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ...functions import dims as D
from ...functions import text as X
from . import finding as R


def weight_file(path: Column, dims: D.Dictionaries) -> Column:
    """Looks at the path only, never at the content."""
    name = X.base_name(path)
    return F.array(R.finding(
        R.WEIGHTS, name, "local", F.concat(F.lit("Model Weight ("), X.extension(name), F.lit(")")), "High",
        "Locally hosted model weight file detected", path,
    ))


def kubernetes_gpu(path: Column, content: Column) -> Column:
    wasteful = X.let(F.lower(content), lambda low: (
        X.contains_any(low, D.GPU_RESOURCE_KEYS) & ~X.contains_any(low, D.GPU_SHARING_KEYS)
    ))
    return R.when_mentioned(wasteful, F.array(R.finding(
        R.KUBERNETES, X.base_name(path), None, None, "Warning",
        "Expensive GPU requested without MIG or time-slicing configuration. Potential cost inefficiency.",
        path,
    )))


def helm_values(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    def flags(low):
        return F.struct(
            X.contains_any(low, D.GPU_RESOURCE_KEYS).alias("gpu"),
            X.contains_any(low, D.AUTOSCALING_KEYS).alias("scaled"),
            X.contains_any(low, dims.serving_patterns).alias("serving"),
        )

    def findings(seen):
        gpu = F.when(seen["gpu"], R.finding(
            R.HELM, X.base_name(path), None, None, F.when(seen["scaled"], "Info").otherwise("Warning"),
            F.concat(F.lit("GPU resource requests detected in Helm values. "), F.when(
                seen["scaled"], "Autoscaling is configured — good cost optimization practice."
            ).otherwise(
                "No autoscaling configuration found — fixed GPU allocation may lead to cost waste "
                "during low-traffic periods."
            )),
            path, seq=0,
        ))
        serving = F.when(seen["serving"], R.finding(
            R.HELM, X.base_name(path), None, None, "Info",
            "AI model serving framework configuration detected in Helm values. Consider batching inference "
            "requests for GPU utilization optimization.",
            path, seq=1,
        ))
        return R.present(F.array(gpu, serving))

    return X.let(X.let(F.lower(content), flags), findings)


def terraform_gpu(path: Column, content: Column, dims: D.Dictionaries) -> Column:
    families = D.struct_array(
        [(cloud, key, desc)
         for cloud, table in dims.gpu_families.items() for key, desc in sorted(table.items())],
        ("cloud", "key", "desc"),
    )

    def hits(low):
        return F.struct(
            F.filter(families, lambda f: F.contains(low, f["key"])).alias("families"),
            X.contains_any(low, D.SPOT_KEYS).alias("spot"),
        )

    def findings(seen):
        advice = F.when(
            seen["spot"], " Spot/preemptible pricing detected — good cost optimization."
        ).otherwise(
            " Consider using spot/preemptible instances for 60-90%% cost savings on non-critical workloads."
        )
        return F.transform(seen["families"], lambda f, i: R.finding(
            R.TERRAFORM, X.base_name(path), None, None, F.when(seen["spot"], "Info").otherwise("Warning"),
            F.concat(f["cloud"], F.lit(" instance detected in Terraform config: "), f["desc"], F.lit("."), advice),
            path, seq=i,
        ))

    return X.let(X.let(F.lower(content), hits), findings)
