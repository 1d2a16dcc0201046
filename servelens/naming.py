"""Names that belong to a deployment rather than to the engine.

Fixed values: the defaults below are the prefixes found in recorded samples and
rule files.  Override them to analyse another deployment.
"""

from dataclasses import dataclass


@dataclass(frozen=True)
class Naming:
    """Prefixes put in front of metric, alert and job names."""

    metric: str = "mlx_"
    alert: str = "MLX"
    job: str = "mlx-"
    trace_header: str = "x-mlx-trace"

    def m(self, name: str) -> str:
        return self.metric + name

    def a(self, name: str) -> str:
        return self.alert + name

    def j(self, name: str) -> str:
        return self.job + name


DEFAULT_NAMING = Naming()

# Histogram bounds per metric (without the +Inf bucket).
BOUNDS = {
    "ttft_seconds": (0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0),
    "generation_seconds": (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0, 120.0),
    "token_rate_tokens_per_second": (1, 2, 5, 10, 20, 40, 80, 160, 320, 640),
    "hallucination_risk_histogram": (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0),
    "queue_wait_seconds": (0.001, 0.005, 0.01, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0),
    "output_perplexity_histogram": (1.05, 1.1, 1.25, 1.5, 2.0, 3.0, 5.0, 8.0, 13.0, 21.0, 50.0),
    "token_entropy_histogram": (0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.75, 1.0, 1.5, 2.0, 3.0),
}
