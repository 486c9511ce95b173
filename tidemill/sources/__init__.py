"""Sources: delimited files, sockets, paced replay and generators."""
