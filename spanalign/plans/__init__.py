"""All registered queries: importing the modules fills the registry."""

from spanalign.plans import corpus, harness, inference, replicates, scoring, segmentation, streams
from spanalign.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "corpus", "harness", "inference", "replicates", "scoring", "segmentation", "streams"]
