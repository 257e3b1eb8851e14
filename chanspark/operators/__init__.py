"""DataFrame operators on packet tables, channel arrays and labelled windows."""
