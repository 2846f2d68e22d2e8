"""Jobs over unbounded metric logs."""
