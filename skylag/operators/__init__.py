"""Set-at-a-time operators over tables of flights."""
