"""Sources: tables of a folder, files of a tree, package manifests."""
