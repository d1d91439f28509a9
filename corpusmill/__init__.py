"""A Spark-native engine that cleans, filters, samples and de-duplicates datasets for training language models."""

from .dataset import Dataset
from .errors import ConfigError, MillError, OperatorError, PipelineError, SchemaError
from .operators import *  # noqa: F403 - registers the operators
from .pipeline import Pipeline
from .registry import apply_operator, names, operator

__all__ = ["ConfigError", "Dataset", "MillError", "OperatorError", "Pipeline", "PipelineError", "SchemaError", "apply_operator", "names", "operator"]
