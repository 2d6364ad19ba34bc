"""Dataset pipelines on Spark."""

from .operators.chat import CHATML, ChatTemplate, ChatTemplateBuilder
from .plans.pipeline import Chain, InternalDatasetType, IterBy, JudgeType, Metadata, Pipeline, PipelineRunner, StepError
from .session import get_spark
from .sources.tools import Tools, class_to_schema, function_to_schema

__all__ = ["CHATML", "Chain", "ChatTemplate", "ChatTemplateBuilder", "InternalDatasetType", "IterBy", "JudgeType", "Metadata", "Pipeline", "PipelineRunner", "StepError", "Tools", "class_to_schema", "function_to_schema", "get_spark"]
