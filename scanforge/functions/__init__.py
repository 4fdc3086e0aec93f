"""scanforge subpackage."""
