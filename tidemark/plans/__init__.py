"""From a task to a checked plan to a run."""
