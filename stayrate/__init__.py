"""Customer-retention analytics on Spark DataFrames."""

from stayrate.config import RetentionConfig, SegmentRule, config_from_mapping, load_config

__all__ = ["RetentionConfig", "SegmentRule", "config_from_mapping", "load_config"]
