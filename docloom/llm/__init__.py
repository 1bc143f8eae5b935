"""Training-data operators.  Nothing else in the package imports this folder;
``__spark_entry__`` registers its queries only when it can be imported."""
