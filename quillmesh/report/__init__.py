"""Reports on several methods over one cohort."""
