"""Operators over pair, keypoint, flow, surface, feature and metric tables."""
